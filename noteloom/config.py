"""Settings: a file, then the environment, which wins; every problem is reported at once."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

import yaml

from noteloom.schemas import COLLECTIONS, is_slug

PREFIX = "NOTELOOM_"
KEYS = ("tables", "collection", "tenant", "embedding_model", "golden", "baseline", "state", "locks", "report", "embedder")
#: Settings of one vault: folder, areas, folders and root files that the walk passes over.
VAULT_KEYS = ("path", "areas", "exclude_folders", "exclude_root_files")
#: What each command needs.
REQUIRED = {"ingest": ("tables", "collection", "tenant", "embedding_model"), "search": ("tables", "collection", "tenant"), "stats": ("tables",), "eval": ("tables", "collection"), "measure-search": ("tables", "collection", "tenant"), "measure-ingest": ("tables", "collection", "tenant", "embedding_model"), "schema": ("tables", "embedding_model")}


class ConfigError(ValueError):
    pass


#: Settings whose names end so are secrets: shown as stars, taken out of messages.
SECRET = ("key", "token", "password", "secret")
STARS = "***"


def is_secret(name: str) -> bool:
    return name.lower().endswith(SECRET)


def redacted(values: Mapping[str, str]) -> dict[str, str]:
    return {k: STARS if v and is_secret(k) else v for k, v in values.items()}


def scrub(message: str, values: Mapping[str, str]) -> str:
    """A message without the value of any secret."""
    for value in sorted((v for k, v in values.items() if v and is_secret(k)), key=len, reverse=True):
        message = message.replace(value, STARS)
    return message


@dataclass(frozen=True)
class Vault:
    name: str
    path: str
    areas: tuple[str, ...]
    exclude_folders: tuple[str, ...] = ()
    exclude_root_files: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    values: Mapping[str, str]
    vaults: tuple[Vault, ...] = field(default_factory=tuple)

    def __getattr__(self, name: str) -> str:
        if name in KEYS:
            return self.values.get(name, "")
        raise AttributeError(name)

    def require(self, command: str) -> Config:
        absent = [k for k in REQUIRED.get(command, ()) if not self.values.get(k)]
        if absent:
            raise ConfigError(f"{command} needs {', '.join(absent)}")
        return self

    def chosen(self, name: str) -> tuple[Vault, ...]:
        """The vault of that name, or all of them for `both` and for nothing."""
        if name in ("", "both"):
            return self.vaults
        own = tuple(v for v in self.vaults if v.name == name)
        if not own:
            raise ConfigError(f"unknown vault {name!r}; there are {', '.join(v.name for v in self.vaults) or 'none'}")
        return own


def load(path: str | None = None, environ: Mapping[str, str] | None = None) -> Config:
    environ = os.environ if environ is None else environ
    values: dict[str, str] = {}
    if path:
        with open(path, encoding="utf-8") as file:
            values = {k: str(v) for k, v in (yaml.safe_load(file) or {}).items()}
    values |= {k.removeprefix(PREFIX).lower(): v for k, v in environ.items() if k.startswith(PREFIX)}
    names = [n for n in values.get("vaults", "").split(",") if n]
    problems, vaults = [], []
    for name in names:
        key = f"vault_{name.replace('-', '_')}"
        areas = tuple(a for a in values.get(f"{key}_areas", "").split(",") if a)
        problems += [f"{what} {x!r}" for what, x in [("vault", name), *[("area", a) for a in areas]] if not is_slug(x)]
        if name == "both":
            problems.append("a vault cannot be called 'both'")
        if not values.get(f"{key}_path") or not areas:
            problems.append(f"vault {name} needs a path and areas")
        excluded = [tuple(x for x in values.get(f"{key}_{k}", "").split(",") if x) for k in VAULT_KEYS[2:]]
        vaults.append(Vault(name, values.get(f"{key}_path", ""), areas, *excluded))
    owned = {f"vault_{n.replace('-', '_')}_{s}" for n in names for s in VAULT_KEYS}
    problems += [f"setting {k} belongs to no vault" for k in sorted(values) if k.startswith("vault_") and k not in owned]
    problems += [f"unknown setting {k}" for k in sorted(values) if k not in KEYS and k != "vaults" and not k.startswith("vault_")]
    if values.get("collection") and values["collection"] not in COLLECTIONS:
        problems.append(f"collection is one of {', '.join(COLLECTIONS)}")
    if problems:
        raise ConfigError("; ".join(problems))
    return Config({k: v for k, v in values.items() if k in KEYS}, tuple(vaults))
