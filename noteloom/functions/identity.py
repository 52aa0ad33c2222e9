"""Point identity and content fingerprint as columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of point ids.
NAMESPACE = "34bf96b9-3a72-4c17-8711-9addd5d8e946"
NUL, UNIT = "\x00", "\x1f"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """RFC 4122 version 5 id of a name, as 36 characters."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def point_id(tenant: Column, uid: Column, chunk_index: Column) -> Column:
    return uuid5(F.concat_ws(":", tenant, uid, chunk_index.cast("string")))


def serialize_list(items: Column) -> Column:
    return F.array_join(F.array_sort(items), UNIT)


def serialize_fields(fields: Mapping[str, Column]) -> Column:
    """`key=value` in byte order of the keys, joined by NUL. The keys are known when the plan is made."""
    return F.concat_ws(NUL, *[F.concat(F.lit(f"{k}="), F.coalesce(fields[k], F.lit(""))) for k in sorted(fields, key=str.encode)])


def point_hash(text: Column, fields: Mapping[str, Column]) -> Column:
    """sha256 over the byte length of the text, the text and the field block."""
    return F.sha2(F.concat(F.octet_length(text).cast("string"), F.lit(NUL), text, F.lit(NUL), serialize_fields(fields)), 256)


def golden_identity(question: Column, uid: Column) -> Column:
    return F.sha2(F.concat(question, F.lit(NUL), uid), 256)


#: Note metadata that enters the fingerprint; `updated` does not.
METADATA = ("vault", "path", "type", "status", "visibility", "title", "lang", "area", "sub")


def fingerprint_fields(pipeline: Mapping[str, str], embedder: Mapping[str, str]) -> dict[str, Column]:
    """Fields of a chunk row (columns named like the payload) together with pipeline and embedder settings."""
    out = {c: F.col(c) for c in METADATA}
    out |= {
        "tags": serialize_list(F.col("tags")), "headings": serialize_list(F.col("headings")), "created": F.col("created"), "tenant_id": F.col("tenant_id"), "uid": F.col("uid"),
        "chunk_index": F.col("chunk_index").cast("string"), "oversize": F.col("oversize").cast("string"),
    }
    out |= {f"pipeline_{k}": F.lit(v) for k, v in pipeline.items()} | {f"embedder_{k}": F.lit(v) for k, v in embedder.items()}
    return out
