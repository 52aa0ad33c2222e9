"""Entities, closed sets, collection manifest and drift checks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Closed sets of the data model.
NOTE_TYPES = ("concept", "moc", "project", "post", "lesson", "reference", "template", "log", "lore", "character", "script", "prompt", "index", "agent", "skill")
STATUSES = ("draft", "in-progress", "stable", "archived")
VISIBILITIES = ("private", "internal", "shareable")
COLLECTIONS = ("interno", "clientes", "base_paga")
DEFAULT_VISIBILITY = "internal"
SLUG = r"^[a-z0-9]+(-[a-z0-9]+)*$"
UID = r"^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[0-9a-f]{4}-[0-9a-f]{12}$"
CHUNKER_VERSION, MERGE_RULE = "v1", "merge-below-floor"
VECTOR_WIDTH = 1024

NOTE = T.StructType([
    T.StructField("vault", T.StringType()), T.StructField("path", T.StringType()), T.StructField("uid", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("status", T.StringType()), T.StructField("visibility", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("created", T.DateType()), T.StructField("title", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("area", T.StringType()), T.StructField("sub", T.StringType()),
    T.StructField("updated", T.TimestampType()), T.StructField("body", T.StringType()),
])

#: Payload of a stored point; vectors sit beside it and are read only where a distance is computed.
PAYLOAD = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("tenant_id", "uid")], T.StructField("chunk_index", T.IntegerType()),
    *[T.StructField(c, T.StringType()) for c in ("text", "vault", "area", "sub", "path", "type", "status", "visibility")],
    T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("title", T.StringType()), T.StructField("headings", T.ArrayType(T.StringType())),
    T.StructField("lang", T.StringType()), T.StructField("created", T.StringType()), T.StructField("updated", T.StringType()),
    T.StructField("oversize", T.BooleanType()), T.StructField("embedding_model", T.StringType()), T.StructField("point_hash", T.StringType()),
])
RESULT_FIELDS = ("uid", "chunk_index", "text", "path", "headings", "title")
#: Columns a filter may name; anything else is refused (strict mode).
FILTERABLE = ("tenant_id", "uid", "area", "type", "status", "visibility", "vault", "tags", "chunk_index")


class EmbedderMismatch(ValueError):
    """The embedder is not the one that an index was built with."""


@dataclass(frozen=True)
class Handshake:
    """The seven settings that index and embedder must agree on."""

    model_revision: str
    tokenizer_revision: str
    dim: int
    normalization: str
    pooling: str
    precision: str
    sparse_params: str = ""

    def mismatches(self, other: Handshake) -> list[str]:
        return [f.name for f in fields(self) if getattr(self, f.name) != getattr(other, f.name)]

    def require(self, other: Handshake) -> None:
        if bad := self.mismatches(other):
            raise EmbedderMismatch(f"the embedder differs in {', '.join(bad)}")


class SchemaDrift(ValueError):
    """The stored table does not have the shape or model that the manifest states."""


@dataclass(frozen=True)
class Manifest:
    name: str
    model: str
    width: int = VECTOR_WIDTH
    distance: str = "cosine"
    filterable: tuple[str, ...] = FILTERABLE
    payload: T.StructType = field(default_factory=lambda: PAYLOAD)


def manifests(model: str, width: int = VECTOR_WIDTH) -> dict[str, Manifest]:
    return {name: Manifest(name, model, width) for name in COLLECTIONS}


def drift(manifest: Manifest, stored: DataFrame, applied_model: str | None = None) -> list[str]:
    """Every difference between a manifest and a stored table; nothing is repaired."""
    have = {f.name: f.dataType for f in stored.schema}
    out = [f"missing column {f.name}" if f.name not in have else f"column {f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in manifest.payload if have.get(f.name) != f.dataType]
    out += [f"filterable column {c} is missing" for c in manifest.filterable if c not in have]
    if applied_model is not None and applied_model != manifest.model:
        out.append(f"the stored vectors come from {applied_model}, not {manifest.model}")
    return out


def check_applied(manifest: Manifest, stored: DataFrame | None, applied_model: str | None = None) -> str:
    """`create` for a collection that does not exist, `verified` for one that matches; drift raises."""
    if stored is None:
        return "create"
    if found := drift(manifest, stored, applied_model):
        raise SchemaDrift("; ".join(found))
    return "verified"


def is_slug(name: str) -> bool:
    return re.match(SLUG, name) is not None
