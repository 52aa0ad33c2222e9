"""Posting lists of blocks of points, and the best points of many questions from them with bounds.

A block has points of one tenant, in the order of the length (`norm`) of their vectors, longest first: for each of their terms a
list of rows and weights, and the largest weight. Questions lie in blocks of the same form. Of a question the score is known
that its answer reaches at least (`floor`). A product is at most the product of both lengths, and at most the sum of the
shares of a block's largest weights: blocks, questions and points that stay below the floor are not scored. The result is
that of the whole dot product, and a task holds one pair of blocks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StructField, StructType

from noteloom.operators.batches import bounded_batches
from noteloom.operators.blocks import _gathered, _lists
from noteloom.operators.postings import SPARSE

#: Points and questions of a block, entries of its lists at most (one row may have more), and points of a tenant that give the
#: first floor.
POINTS, QUESTIONS, ENTRIES, HEAD = 512, 128, 250_000, 512
#: What rounding to six places, and sums in another order, may move a score by.
SLACK, RELATIVE = 2e-6, 1e-9
#: Share of all pairs that a term's lists need to be scored by a product of matrices, how many terms at most are (the others
#: meet entry by entry), and pairs of entries that meet at a time.
FREQUENT, MOST_FREQUENT, MOST_PAIRS = 0.02, 4096, 2_000_000
PARTS = {"terms": np.int64, "largest": np.float64, "lengths": np.int32, "rows": np.int32, "weights": np.float64}


def norm(sparse: Column) -> Column:
    return F.sqrt(F.aggregate(sparse, F.lit(0.0), lambda total, p: total + p["weight"] * p["weight"]))


def floor(least: Column) -> Column:
    """What a point must reach if the `limit`-th best of a question is at least `least`."""
    return F.greatest(least * (1 - RELATIVE) - SLACK, F.lit(0.0))


def counted(rows: DataFrame) -> DataFrame:
    """tenant_id, point_id, sparse and its norm: how often each term occurs; nothing of points without terms. rows: tenant_id,
    point_id, terms (numbers, one for each time a word occurs)."""
    bounded_batches(rows.sparkSession)
    own = rows.select("tenant_id", "point_id", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, starts, sizes = _lists(batch.column("terms"))
            sizes = np.maximum(sizes, 0)
            terms, at = _gathered(values, starts, sizes), np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((terms, at))
            terms, at = terms[order], at[order]
            first = np.flatnonzero(np.concatenate((np.ones(min(len(terms), 1), bool), (terms[1:] != terms[:-1]) | (at[1:] != at[:-1]))))
            weights = np.diff(np.append(first, len(terms))).astype(np.float64)
            offsets = np.searchsorted(at[first], np.arange(len(sizes) + 1)).astype(np.int32)
            sparse = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(terms[first]), pa.array(weights)], names=["id", "weight"]))
            norms = np.sqrt(np.bincount(at[first], weights * weights, len(sizes)))
            yield pa.RecordBatch.from_arrays([batch.column("tenant_id"), batch.column("point_id"), sparse, pa.array(norms)], names=["tenant_id", "point_id", "sparse", "norm"])

    shape = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ("tenant_id", "point_id"))
    return own.mapInArrow(run, f"{shape}, sparse {SPARSE}, norm double").where(F.col("norm") > 0)


def heads(points: DataFrame, most: int) -> DataFrame:
    """tenant_id and `cut`: the length that the tenant's `most` longest points have at least."""
    rank = F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("norm")))
    return points.select("tenant_id", "norm").withColumn("rank", rank).where(F.col("rank") <= most).groupBy("tenant_id").agg(F.min("norm").alias("cut"))


def in_order(points: DataFrame) -> DataFrame:
    """Points of a tenant side by side, longest first."""
    order = [F.col("tenant_id"), F.desc("norm"), F.col("point_id")]
    return points.repartitionByRange(*order).sortWithinPartitions(*order)


def packed(rows: DataFrame, row_id: str, most: int) -> DataFrame:
    """Blocks of at most `most` neighbouring rows of one tenant. rows: tenant_id, the id, sparse, norm, floor."""
    bounded_batches(rows.sparkSession)
    own = rows.select("tenant_id", row_id, "sparse", "norm", "floor")
    doubles = ArrayType(DoubleType())
    schema = StructType([own.schema["tenant_id"], StructField("ids", ArrayType(own.schema[row_id].dataType)), StructField("norms", doubles), StructField("floors", doubles), StructField("norm", DoubleType()), StructField("reach", DoubleType()), *[StructField(c, BinaryType()) for c in PARTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tenant, n, entries = [], None, 0, 0
        for batch in batches:
            start = 0
            for i, (t, size) in enumerate(zip(batch.column("tenant_id").to_pylist(), pc.list_value_length(batch.column("sparse")).to_pylist(), strict=True)):
                if n and (t != tenant or n >= most or entries + size > ENTRIES):
                    yield block([*held, batch.slice(start, i - start)])
                    held, n, entries, start = [], 0, 0, i
                tenant, n, entries = t, n + 1, entries + size
            held.append(batch.slice(start))
        if n:
            yield block(held)

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        (part,) = pa.Table.from_batches(held).combine_chunks().to_batches()
        sparse, norms, floors = part.column("sparse"), part.column("norm").to_numpy(), part.column("floor").to_numpy()
        entries = sparse.flatten()
        terms, weights = entries.field("id").to_numpy(), entries.field("weight").to_numpy(zero_copy_only=False)
        if not (weights > 0).all() or not np.isfinite(weights).all():
            raise ValueError("sparse vector: values")
        rows = np.repeat(np.arange(len(part), dtype=np.int32), pc.list_value_length(sparse).to_numpy())
        order = np.argsort(terms, kind="stable")
        terms, weights, rows = terms[order], weights[order], rows[order]
        first = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1])))
        made = {"terms": terms[first], "largest": np.maximum.reduceat(weights, first), "lengths": np.diff(np.append(first, len(terms))), "rows": rows, "weights": weights}
        with np.errstate(divide="ignore"):
            reach = float(np.max(norms / floors))
        listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), values)
        columns = [part.column("tenant_id").slice(0, 1), listed(part.column(row_id)), listed(pa.array(norms)), listed(pa.array(floors)), pa.array([float(norms.max())]), pa.array([reach])]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array([made[c].astype(kind).tobytes()], pa.binary()) for c, kind in PARTS.items()]], names=schema.names)

    return own.mapInArrow(run, schema)


class Block:
    """A block's row of `packed`, read."""

    def __init__(self, batch: pa.RecordBatch, i: int, prefix: str = ""):
        part = lambda c: batch.column(prefix + c)[i]
        self.ids, self.norms, self.floors = part("ids").values, part("norms").values.to_numpy(), part("floors").values.to_numpy()
        self.terms, self.largest, self.lengths, self.rows, self.weights = (np.frombuffer(part(c).as_py(), kind) for c, kind in PARTS.items())
        self.starts = np.cumsum(self.lengths) - self.lengths


def _entries(block: Block, lists: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in `lists`, row and weight of the entries of these lists whose row is kept."""
    sizes = block.lengths[lists]
    rows, place = _gathered(block.rows, block.starts[lists], sizes), np.repeat(np.arange(len(lists)), sizes)
    weights = _gathered(block.weights, block.starts[lists], sizes)
    met = keep[rows]
    return place[met], rows[met], weights[met]


def scores(q: Block, p: Block) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the questions that a point of the block may answer, and their scores by point, of the first points that may."""
    none = np.zeros(0, np.int64), np.zeros((0, 0))
    more = 1 + RELATIVE
    alive = q.norms * p.norms.max() * more >= q.floors
    at = np.minimum(np.searchsorted(p.terms, q.terms), len(p.terms) - 1)
    shared = np.flatnonzero(p.terms[at] == q.terms)
    if not alive.any() or not len(shared):
        return none
    place, rows, weights = _entries(q, shared, alive)
    bound = np.bincount(rows, weights * p.largest[at[shared]][place], len(q.norms))
    alive &= (bound > 0) & (bound * more >= q.floors)
    if not alive.any():
        return none
    asked = np.flatnonzero(alive)
    taken = p.norms * np.max(q.norms[asked] * more / np.maximum(q.floors[asked], 1e-300)) >= 1
    met = alive[rows]
    place, rows, weights = place[met], (np.cumsum(alive) - 1)[rows[met]], weights[met]
    p_place, p_rows, p_weights = _entries(p, at[shared], taken)
    p_rows = (np.cumsum(taken) - 1)[p_rows]
    nq, np_ = len(asked), int(taken.sum())
    lengths, p_lengths = (np.bincount(x, minlength=len(shared)) for x in (place, p_place))
    pairs = lengths * p_lengths
    often = pairs >= np.maximum(FREQUENT * nq * np_, 1)
    often[np.argsort(-pairs, kind="stable")[MOST_FREQUENT:]] = False
    out = np.zeros((nq, np_))
    if often.any():
        column = np.cumsum(often) - 1
        a, b = np.zeros((nq, int(often.sum()))), np.zeros((int(often.sum()), np_))
        x, y = often[place], often[p_place]
        a[rows[x], column[place[x]]] = weights[x]
        b[column[p_place[y]], p_rows[y]] = p_weights[y]
        out += a @ b
        p_place, p_rows, p_weights = p_place[~y], p_rows[~y], p_weights[~y]
    starts, sizes = np.cumsum(lengths) - lengths, lengths[p_place]
    total = np.cumsum(sizes)
    cuts = np.append(np.searchsorted(total, np.arange(0, int(total[-1]) if len(total) else 0, MOST_PAIRS)), len(p_place))
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        n = sizes[x:y]
        entry = _gathered(np.arange(len(rows)), starts[p_place[x:y]], n)
        out += np.bincount(rows[entry] * np.int64(np_) + np.repeat(p_rows[x:y], n), weights[entry] * np.repeat(p_weights[x:y], n), nq * np_).reshape(nq, np_)
    whole = np.full((nq, len(p.norms)), -np.inf)
    whole[:, taken] = np.where(out > 0, out, -np.inf)
    return asked, whole


def best_of(found: np.ndarray, floors: np.ndarray, limit: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of scores that may be among the best `limit` of their row. order: ranks of the points by id; of equal
    scores the `limit` first ids are enough."""
    least = floors[:, None]
    if found.shape[1] > limit:
        kth = -np.partition(-found, limit - 1, axis=1)[:, limit - 1 : limit]
        least = np.maximum(least, np.where(np.isfinite(kth), kth * (1 - RELATIVE) - SLACK, 0))
    x, y = np.nonzero((found >= least) & (found > 0))
    score = found[x, y]
    by = np.lexsort((order[y], -score, x))
    x, y, score = x[by], y[by], score[by]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(x), 1), bool), (x[1:] != x[:-1]) | (score[1:] != score[:-1]))))
    nth = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    return x[nth < limit], y[nth < limit]


def best_pairs(asked: DataFrame, lists: DataFrame, limit: int) -> DataFrame:
    """query_id, point_id, sparse_score of the pairs that may be among the best `limit` of a question. asked, lists: `packed`."""
    q = F.broadcast(asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns]))
    pairs = lists.join(q, (F.col("tenant_id") == F.col("q_tenant_id")) & (F.col("norm") * F.col("q_reach") >= 1 - RELATIVE))
    names = [f"{s}{c}" for s in ("q_", "") for c in ("ids", "norms", "floors", *PARTS)]
    id_of = lambda df: df.schema["ids"].dataType.elementType
    schema = StructType([StructField("query_id", id_of(asked)), StructField("point_id", id_of(lists)), StructField("sparse_score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                questions, points = Block(batch, i, "q_"), Block(batch, i)
                rows, found = scores(questions, points)
                order = np.argsort(pc.sort_indices(points.ids).to_numpy())
                x, y = best_of(found, questions.floors[rows], limit, order)
                yield pa.RecordBatch.from_arrays([questions.ids.take(pa.array(rows[x])), points.ids.take(pa.array(y)), pa.array(found[x, y])], names=schema.names)

    return pairs.select(*names).mapInArrow(run, schema)
