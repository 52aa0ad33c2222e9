"""Vector arithmetic as columns, sparse conversion, validation and a deterministic embedder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteloom.functions.arrays import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(a: Column) -> Column:
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column, digits: int = 6) -> Column:
    """Rounded, so that ranks do not hang on the last bits."""
    return F.round(dot(a, b) / (norm(a) * norm(b)), digits)


def sparse(weights: Column) -> Column:
    """map id -> weight to ascending (id, weight) pairs with positive weights."""
    return F.sort_array(F.map_entries(F.map_filter(weights, lambda _, v: v > 0)))


def embedding_error(dense: Column, width: int) -> Column:
    """Why a dense vector is unusable; null if it is fine."""
    finite = F.forall(dense, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(dense.isNull(), "missing").when(F.size(dense) != width, "width").when(~finite, "not finite").when(norm(dense) == 0, "zero")


def sparse_error(indices: Column, values: Column) -> Column:
    """Why a sparse vector is unusable; null if it is fine."""
    ascending = F.forall(F.zip_with(F.slice(indices, F.lit(1), F.size(indices) - 1), F.slice(indices, F.lit(2), F.size(indices) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["a"] < p["b"])
    good = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))) & (v != 0))
    return F.when(F.size(indices) != F.size(values), "lengths").when(F.size(indices) == 0, "empty").when((F.size(indices) > 1) & ~ascending, "order").when(~good, "values")


def hash_embedding(text: Column, width: int = 64) -> Column:
    """A deterministic unit vector of a text, for tests and dry runs."""
    seed = F.md5(text)
    number = lambda i: F.conv(F.substring(F.md5(F.concat(seed, F.lit(":"), i.cast("string"))), 1, 8), 16, 10).cast("double")
    return let(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: number(i) / float(1 << 31) - 1.0), normalized)


def rrf(dense_rank: Column, sparse_rank: Column, k: int = 60, digits: int = 9) -> Column:
    """Reciprocal rank fusion; a missing rank adds nothing."""
    return F.round(F.coalesce(1.0 / (k + dense_rank), F.lit(0.0)) + F.coalesce(1.0 / (k + sparse_rank), F.lit(0.0)), digits)
