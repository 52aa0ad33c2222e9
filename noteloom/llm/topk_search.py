"""Exact top-k search: pivot-distance index.

Vectors get one more coordinate, sqrt(M - |x|^2), so that the largest inner product with a query (0 there) is the
smallest Euclidean distance. Each vector is keyed by its nearest pivot and its distance to it; sorted by that key, runs
of rows form annuli. A query first searches the annuli with the highest bounds, which gives its k-th score; then it
expands to every annulus that no bound rules out: the triangle inequality distance(q, x) >= |distance(q, p) - distance(x, p)|,
and for the inner product itself q.x <= q.p + |q||x - p| and q.x <= |q||x|, with the largest |x - p| and |x| of the annulus.
Pivots are fitted on at most `sample_rows` vectors; every vector is indexed, and results are exact. Queries and annuli
meet as packed blocks of bounded size, never as all pairs of rows; `visited_share` tells how much the bounds leave.

Nulls: rows with a null id or vector, or a null or non-finite component, take no part. Vectors of unequal length are
padded with zeros. Rows that share the query's id count as the query's own row; a repeated query id is asked once.
With fewer than k candidates all are returned; equal scores go to the smaller id. Empty tables give empty results;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.common import materialize

SCALE = 1024
#: The directory that each planning task holds has at most about this many annuli.
MAX_ANNULI = 100_000
#: Rows of a block (an annulus is one block or more), of a block of queries, and queries planned at a time.
BLOCK_ROWS, QUERY_ROWS, PLAN_ROWS = 2048, 256, 16
KEY_SCHEMA = "pivot int, dist double, radius double, norm double, vec_id long, v array<bigint>"
BLOCK_SCHEMA = "annulus string, pivot int, dmin double, dmax double, radius double, norm double, n int, ids binary, data binary"


def quantize(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and floor(scale * x) of each component, for rows whose components are all finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(scale))).alias("v"),
    )


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class PivotIndex:
    def __init__(self, pivots: np.ndarray, dim: int, norm: float, kind: str, blocks: DataFrame, directory: pd.DataFrame):
        """pivots: with the further coordinate; norm: the largest squared norm; kind: type of stored components."""
        self.pivots, self.dim, self.norm, self.kind, self.blocks, self.directory = pivots, dim, norm, kind, blocks, directory

    @classmethod
    def build(cls, vectors: DataFrame, pivots: int = 48, sample_rows: int = 4096) -> PivotIndex | None:
        """vectors: vec_id long, v array<bigint>. None for an empty table."""
        norm2 = F.aggregate("v", F.lit(0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"))
        n, dim, norm, low, high = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(norm2), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
        if not n:
            return None
        dim = max(dim, 1)
        kind = next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= min(low or 0, 0) and max(high or 0, 0) <= np.iinfo(t).max)
        sample = _matrix(vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()["v"], dim)
        centres = _fit(_augment(sample, norm), pivots)
        keyed = vectors.mapInPandas(_key(centres, dim, norm), KEY_SCHEMA)
        rows = max(BLOCK_ROWS, -(-n // MAX_ANNULI))
        packed = keyed.repartitionByRange("pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id").mapInPandas(_packer(dim, kind, rows), BLOCK_SCHEMA)
        blocks = materialize(packed, "annuli")
        # At most MAX_ANNULI + partitions + pivots rows.
        directory = blocks.groupBy("annulus", "pivot").agg(F.min("dmin").alias("dmin"), F.max("dmax").alias("dmax"), F.max("radius").alias("radius"), F.max("norm").alias("norm"), F.sum("n").alias("n")).toPandas()
        return cls(centres, dim, norm, kind, blocks, directory.sort_values(["pivot", "dmin", "annulus"], ignore_index=True))

    def _plan(self, first: bool, k: int):
        dim, kind, directory, pivots, norm = self.dim, self.kind, self.directory, self.pivots, self.norm
        sizes, names = directory["n"].to_numpy(), directory["annulus"].to_numpy()

        def early(best: np.ndarray) -> np.ndarray:
            """The annuli with the highest bounds, until they hold k rows and the query itself."""
            order = np.argsort(-best, axis=1, kind="stable")
            need = (np.cumsum(sizes[order], axis=1) < k + 1).sum(1) + 1
            out = np.zeros(best.shape, dtype=bool)
            for i in range(len(best)):
                out[i, order[i, : need[i]]] = True
            return out

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for row in b.itertuples(index=False):
                    q, ids = np.frombuffer(row.q_data, kind).reshape(-1, dim), np.frombuffer(row.q_ids, np.int64)
                    known = {} if first or row.scores is None else {x["query_id"]: x["score"] for x in row.scores}
                    take = np.zeros((len(q), len(names)), bool)
                    for at in range(0, len(q), PLAN_ROWS):
                        best = _bounds(q[at : at + PLAN_ROWS], directory, pivots, norm)
                        near = early(best)
                        floor = np.array([known.get(int(x), -np.inf) for x in ids[at : at + PLAN_ROWS]])
                        take[at : at + PLAN_ROWS] = near if first else ~near & (best >= floor[:, None])
                    met = np.flatnonzero(take.any(0))
                    if len(met):
                        yield pd.DataFrame({"asked": row.asked, "annulus": names[met], "n": sizes[met], "rows": [np.flatnonzero(take[:, j]).astype(np.int32) for j in met]})

        return run

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """query_id, rank, vec_id, score."""
        return self._search(queries, k)[0]

    def visited_share(self, queries: DataFrame, k: int = 10) -> float:
        """Pairs of a query and a row that were scored, of all."""
        _, near, far = self._search(queries, k)
        pairs = near.unionByName(far).agg(F.sum(F.col("n") * F.size("rows"))).first()[0] or 0
        return pairs / max(1, int(self.directory["n"].sum()) * queries.select("vec_id").distinct().count())

    def _search(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        dim, kind = self.dim, self.kind
        asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
        keyed = asked.mapInPandas(_key(self.pivots, dim, None), KEY_SCHEMA)
        packed = keyed.repartitionByRange("pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id").mapInPandas(_packer(dim, kind, QUERY_ROWS), BLOCK_SCHEMA)
        asked_blocks = materialize(packed.select(F.col("annulus").alias("asked"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "asked")

        def meet(pairs: DataFrame) -> DataFrame:
            blocks = self.blocks.select("annulus", "ids", "data")
            return pairs.join(asked_blocks, "asked").join(blocks, "annulus").select("asked", "rows", "q_ids", "q_data", "ids", "data").mapInPandas(_scorer(dim, kind, k), "asked string, query_id long, vec_id long, score long")

        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        pair_schema = "asked string, annulus string, n long, rows array<int>"
        first = asked_blocks.mapInPandas(self._plan(True, k), pair_schema)
        near = materialize(meet(first).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "near")
        floor = near.groupBy("asked", "query_id").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") >= k)
        floors = floor.groupBy("asked").agg(F.collect_list(F.struct("query_id", "score")).alias("scores"))  # at most QUERY_ROWS a row
        second = asked_blocks.join(floors, "asked", "left").mapInPandas(self._plan(False, k), pair_schema)
        found = near.drop("rank").unionByName(meet(second)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return found.select("query_id", "rank", "vec_id", "score"), first, second


def _bounds(q: np.ndarray, directory: pd.DataFrame, pivots: np.ndarray, norm2: float) -> np.ndarray:
    """The largest inner product that each query may have in each annulus, and somewhat more than that."""
    pivot, dmin, dmax, radius, norm = (directory[c].to_numpy() for c in ("pivot", "dmin", "dmax", "radius", "norm"))
    x = q.astype(np.float64)
    square = (x**2).sum(1)
    length = np.sqrt(square)[:, None]
    at = _distances(_augment(x, None), pivots)[:, pivot]
    low = np.maximum(0, np.maximum(at - dmax, dmin - at))
    best = (square[:, None] + norm2 - low**2) / 2
    best = np.minimum(best, (x @ pivots[:, :-1].T)[:, pivot] + length * radius)
    best = np.minimum(best, length * norm)
    return best + 1e-9 * np.abs(best) + 1e-6 * (1 + length * np.sqrt(norm2))


def _key(centres: np.ndarray, dim: int, norm: float | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(b["v"], dim)
            d = _distances(_augment(x, norm), centres)
            nearest = d.argmin(1)
            radius = np.sqrt(((x - centres[nearest, :-1]) ** 2).sum(1))
            yield pd.DataFrame({"pivot": nearest.astype(np.int32), "dist": d[np.arange(len(b)), nearest], "radius": radius, "norm": np.sqrt((x.astype(np.float64) ** 2).sum(1)), "vec_id": b["vec_id"], "v": b["v"]})

    return run


def _augment(m: np.ndarray, norm: float | None) -> np.ndarray:
    x = m.astype(np.float64)
    last = np.zeros(len(x)) if norm is None else np.sqrt(np.maximum(0, norm - (x**2).sum(1)))
    return np.column_stack([x, last])


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)))


def _fit(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    centres = np.unique(sample, axis=0)
    centres = centres[:: max(1, len(centres) // k)][:k].copy()
    for _ in range(rounds):
        nearest = _distances(sample, centres).argmin(1)
        for j in range(len(centres)):
            if (own := nearest == j).any():
                centres[j] = sample[own].mean(0)
    return centres


def _packer(dim: int, kind: str, rows: int):
    """Runs of at most `rows` rows with one pivot, in key order, as annuli of packed blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, held, pivot, size, held_rows = TaskContext.get().partitionId(), 0, [], None, 0, 0

        def block() -> pd.DataFrame:
            b = pd.concat(held)
            extremes = {"dmin": b["dist"].min(), "dmax": b["dist"].max(), "radius": b["radius"].max(), "norm": b["norm"].max()}
            return pd.DataFrame([{"annulus": f"{part}-{number}", "pivot": pivot, **extremes, "n": len(b), "ids": b["vec_id"].to_numpy(np.int64).tobytes(), "data": _matrix(b["v"], dim).astype(kind).tobytes()}])

        for b in batches:
            for p, own in b.groupby("pivot", sort=True):
                at = 0
                while at < len(own):
                    if held and (p != pivot or size == rows or held_rows == BLOCK_ROWS):
                        yield block()
                        held, held_rows = [], 0
                        if p != pivot or size == rows:
                            number, size = number + 1, 0
                    pivot, piece = p, own.iloc[at : at + min(rows - size, BLOCK_ROWS - held_rows)]
                    held.append(piece)
                    size, held_rows, at = size + len(piece), held_rows + len(piece), at + len(piece)
        if held:
            yield block()

    return run


def _scorer(dim: int, kind: str, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                ids, x = np.frombuffer(row.ids, np.int64), np.frombuffer(row.data, kind).reshape(-1, dim).astype(np.int64)
                q_ids, q = np.frombuffer(row.q_ids, np.int64)[row.rows], np.frombuffer(row.q_data, kind).reshape(-1, dim)[row.rows].astype(np.int64)
                exact = dim * float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) < 2**53
                scores = (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if exact else q @ x.T
                out = []
                for i, query in enumerate(q_ids):
                    s, own = scores[i], ids != query
                    kept = np.flatnonzero(own)
                    if len(kept) > k:
                        edge = np.partition(s[kept], len(kept) - k)[len(kept) - k]
                        kept = kept[s[kept] >= edge]
                    top = kept[np.lexsort((ids[kept], -s[kept]))[:k]]
                    out.append(pd.DataFrame({"asked": row.asked, "query_id": query, "vec_id": ids[top], "score": s[top]}))
                if out:
                    yield pd.concat(out)

    return run


def top_k(embeddings: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    vectors = materialize(quantize(embeddings), "vectors")
    index = PivotIndex.build(vectors)
    if index is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return index.search(vectors.where(is_query), k)


def oracle(k: int = 10, every: int = 100) -> str:
    return f"""
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM ints q JOIN ints x ON q.vec_id <> x.vec_id WHERE q.vec_id % {every} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= {k}"""
