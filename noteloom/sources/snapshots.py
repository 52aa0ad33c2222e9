"""Point tables as immutable snapshots: data folders that never change, a manifest of each state, one pointer.

    <table>/<part table>/run=<run>/<partition folders>/*.parquet
    <table>/_snapshots/<number>.json     which folders make up a state, and what it was made from
    <table>/_current                     the number of the state that readers see

A run writes its folders under a name of its own, then a manifest, then replaces the pointer by one rename: readers see the
old state whole or the new state whole. A run that dies leaves folders that no manifest names. Old states stay readable
until they expire. Writers hold the lease of the table; its number is stored with each state, and a lower one is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from noteloom.sources.files import Exists, Folder

KEPT = 5


class Conflict(RuntimeError):
    """Another run committed first, or the run holds an old lease."""


@dataclass(frozen=True)
class Snapshot:
    number: int = 0
    parent: int = 0
    fence: int = 0
    tables: Mapping[str, Sequence[str]] = field(default_factory=dict)  # part table -> its folders, from run=... on
    info: Mapping[str, object] = field(default_factory=dict)

    def parts(self, table: str, **values: Sequence[object]) -> list[str]:
        """Folders of a part table, only those whose partition columns have one of the given values."""
        wanted = {k: {str(v) for v in own} for k, own in values.items()}
        return [p for p in self.tables.get(table, ()) if all(unescape(dict(s.split("=", 1) for s in p.split("/")).get(k, "")) in own for k, own in wanted.items())]


def unescape(text: str) -> str:
    """A partition value as it was before it became the name of a folder."""
    out, at = [], 0
    while at < len(text):
        if text[at] == "%" and at + 2 < len(text) and all(c in "0123456789abcdefABCDEF" for c in text[at + 1 : at + 3]):
            out.append(chr(int(text[at + 1 : at + 3], 16)))
            at += 3
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.folder = spark, root.rstrip("/"), Folder(spark, root)

    def current(self) -> Snapshot | None:
        number = self.folder.read("_current")
        return self.at(int(number)) if number else None

    def at(self, number: int) -> Snapshot:
        said = self.folder.read(f"_snapshots/{number:08d}.json")
        if said is None:
            raise ValueError(f"snapshot {number} of {self.root} is gone")
        return Snapshot(**json.loads(said))

    def numbers(self) -> list[int]:
        return [int(n.rpartition("/")[2].removesuffix(".json")) for n in self.folder.names("_snapshots/*.json")]

    def read(self, snapshot: Snapshot | None, table: str, schema: str, **values: Sequence[object]) -> DataFrame:
        """A part table of a state; empty if the state has none."""
        parts = snapshot.parts(table, **values) if snapshot else []
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{table}/{p}" for p in parts])

    def stage(self, rows: DataFrame, table: str, by: Sequence[str], run: str) -> list[str]:
        """Write rows of a part table under a run; nobody sees them yet. Returns their folders."""
        rows.write.option("compression", "zstd").partitionBy(*by).parquet(f"{self.root}/{table}/run={run}")
        return ["/".join(n.split("/")[1:]) for n in self.folder.names("/".join([table, f"run={run}", *[f"{c}=*" for c in by]]))]

    def commit(self, base: Snapshot | None, tables: Mapping[str, Sequence[str]], fence: int = 0, info: Mapping[str, object] | None = None, check: Callable[[], None] | None = None) -> Snapshot:
        """The next state. `check` raises if the run may not commit any more; it is asked right before the pointer moves."""
        now = self.current()
        if (now.number if now else 0) != (base.number if base else 0):
            raise Conflict(f"{self.root} is at {now.number if now else 0}, the run started from {base.number if base else 0}")
        if now and fence < now.fence:
            raise Conflict(f"lease {fence} is older than {now.fence}, which committed {now.number}")
        # A manifest that a dead run left holds its number, so numbers can have gaps.
        number = max([now.number if now else 0, *self.numbers()]) + 1
        new = Snapshot(number, now.number if now else 0, fence, {k: list(v) for k, v in tables.items()}, dict(info or (now.info if now else {})))
        try:
            self.folder.create(f"_snapshots/{number:08d}.json", json.dumps(new.__dict__))
        except Exists as e:
            raise Conflict(f"another run commits {number}") from e
        if check:
            check()
        self.folder.replace("_current", str(number), f"_current.{uuid.uuid4().hex}")
        return new

    def expire(self, keep: int = KEPT) -> list[str]:
        """Delete all but the last `keep` states on the way to the current one, and the folders that none of them names.
        Only the holder of the lease may, since a run that is under way has folders that no state names yet."""
        now = self.current()
        if now is None:
            return []
        kept, at = [now], now
        numbers = set(self.numbers())
        while len(kept) < keep and at.parent in numbers:
            at = self.at(at.parent)
            kept.append(at)
        gone = []
        for number in numbers - {s.number for s in kept}:
            self.folder.delete(f"_snapshots/{number:08d}.json")
        used = {f"{t}/{p}" for s in kept for t, parts in s.tables.items() for p in parts}
        runs = {"/".join(u.split("/")[:2]) for u in used}
        for run in self.folder.names("*/run=*"):
            if run not in runs:
                self.folder.delete(run)
                gone.append(run)
                continue
            deep = next(u.count("/") for u in used if u.startswith(run + "/") or u == run) - 1
            for part in self.folder.names(run + "/*" * deep) if deep else []:
                if part not in used:
                    self.folder.delete(part)
                    gone.append(part)
        return gone


def new_run(number: int) -> str:
    return f"{number:08d}-{uuid.uuid4().hex[:12]}"
