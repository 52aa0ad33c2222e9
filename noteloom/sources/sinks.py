"""Driver-side sinks: atomic JSON state, strict baseline, result envelope; the scope of a lock and where one may lie."""

from __future__ import annotations

import hashlib
import json
import os
from typing import Any


def write_json(path: str, data: Any) -> None:
    """Write beside the target, then rename over it."""
    temporary = f"{path}.tmp-{os.getpid()}"
    with open(temporary, "w", encoding="utf-8") as file:
        json.dump(data, file, ensure_ascii=False, indent=2, sort_keys=True)
        file.flush()
        os.fsync(file.fileno())
    os.replace(temporary, path)


def read_json(path: str, keys: set[str]) -> dict[str, Any]:
    """One document with exactly these keys."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    if not isinstance(data, dict) or set(data) != keys:
        raise ValueError(f"{path}: expected the keys {sorted(keys)}")
    return data


def envelope(data: Any = None, error: str | None = None) -> str:
    return json.dumps({"ok": error is None, "data": data, "error": error}, ensure_ascii=False)


class LockHeld(RuntimeError):
    pass


def scope_key(*parts: str) -> str:
    """Digest of length-prefixed parts, so that no two lists of parts collide."""
    return hashlib.sha256("".join(f"{len(p.encode())}:{p}" for p in parts).encode()).hexdigest()


#: File systems whose locks do not hold between hosts.
UNRELIABLE = ("nfs", "nfs4", "cifs", "smb3", "9p", "fuse.sshfs")


def canonical(path: str) -> str:
    """One spelling of a table's place: no scheme of the local disk, no links, dots or trailing slashes."""
    if "://" in path and not path.startswith("file://"):
        return path.rstrip("/")
    local = path.removeprefix("file://").removeprefix("file:")
    return os.path.realpath(local)


def file_system(folder: str, mounts: str = "/proc/mounts") -> str:
    """Type of the file system that holds a folder; empty where the system does not say."""
    try:
        with open(mounts, encoding="utf-8") as file:
            rows = [line.split() for line in file]
    except OSError:
        return ""
    own = [(r[1], r[2]) for r in rows if len(r) > 2 and (os.path.realpath(folder) + "/").startswith(r[1].rstrip("/") + "/")]
    return max(own, key=lambda m: len(m[0]))[1] if own else ""


def check_file_system(folder: str, mounts: str = "/proc/mounts") -> str:
    if (kind := file_system(folder, mounts)) in UNRELIABLE:
        raise ValueError(f"locks do not hold on {kind}: {folder}")
    return kind
