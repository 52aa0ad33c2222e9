"""Questions and points in packed blocks, which are scored pair by pair of blocks.

A block has the rows of one tenant: their ids, and their vectors as bytes. Blocks of points meet the blocks of questions of
their tenant in a broadcast join; a pair of blocks gives each question's best points, so that neither terms nor scores are
shuffled, and a task holds one pair of blocks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from noteloom.operators.batches import bounded_batches

#: Rows of a block, and rows or numbers of vectors that a packing task holds before it lets all blocks go.
DENSE_POINTS, DENSE_QUERIES, SPARSE_POINTS, SPARSE_QUERIES, HELD_ROWS, HELD_NUMBERS = 2048, 256, 512, 128, 16_384, 4_000_000
#: Scores are rounded to six places after a pair of blocks is done: what may still become equal stays.
SLACK = 2e-6
#: Share of a block's questions that a term needs to be scored by a product of matrices, how many terms at most are (the
#: others meet entry by entry), and pairs of entries that meet at a time.
FREQUENT, MOST_FREQUENT, MOST_PAIRS = 0.05, 4096, 2_000_000


def finite_width(dense: Column) -> Column:
    """The vector as doubles, null if it is null or holds a null."""
    return F.when(~F.exists(dense, lambda x: x.isNull()), dense.cast("array<double>"))


def _codes(batch: pa.RecordBatch, on: Sequence[str]) -> np.ndarray:
    """Equal numbers for rows with equal columns `on`."""
    out = np.zeros(batch.num_rows, np.int64)
    for c in on:
        codes = batch.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.unique(out * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)[1]
    return out


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a list column, and the start and length of each row's; a null has length -1."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return column.values.to_numpy(zero_copy_only=False), offsets[:-1], np.where(valid, np.diff(offsets), -1)


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return values[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


class Dense:
    """Vectors of one width; width -1 stands for those that have no score."""

    points, queries = DENSE_POINTS, DENSE_QUERIES

    @staticmethod
    def kinds(sizes: np.ndarray) -> np.ndarray:
        return sizes

    @staticmethod
    def pack(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[bytes, bytes]:
        return b"", _gathered(values, starts, np.maximum(sizes, 0)).astype(np.float64).tobytes()

    @staticmethod
    def scores(q: tuple, p: tuple) -> np.ndarray:
        """Cosines by question and point; -inf where there is none."""
        (nq, kq, _, vq), (np_, kp, _, vp) = q, p
        if kq != kp or kq < 0:
            return np.full((nq, np_), -np.inf)
        a, b = (np.frombuffer(v, np.float64).reshape(n, kq) for n, v in ((nq, vq), (np_, vp)))
        with np.errstate(all="ignore"):
            return (a @ b.T) / (np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None])

    keeps_unscored = True


class Sparse:
    """Numbers of words, one for each time a word occurs; the score is the dot product of how often each occurs."""

    points, queries = SPARSE_POINTS, SPARSE_QUERIES

    @staticmethod
    def kinds(sizes: np.ndarray) -> np.ndarray:
        return np.zeros(len(sizes), np.int64)

    @staticmethod
    def pack(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[bytes, bytes]:
        sizes = np.maximum(sizes, 0)
        terms, rows = _gathered(values, starts, sizes), np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((terms, rows))
        terms, rows = terms[order], rows[order]
        first = np.flatnonzero(np.concatenate(([True], (terms[1:] != terms[:-1]) | (rows[1:] != rows[:-1])))) if len(terms) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(terms)))
        return np.concatenate((rows[first], counts)).astype(np.int32).tobytes(), terms[first].astype(np.int64).tobytes()

    @staticmethod
    def scores(q: tuple, p: tuple) -> np.ndarray:
        """Sums over shared terms by question and point; -inf where no term is shared. Weights are whole, so sums are exact."""
        (nq, _, wq, tq), (np_, _, wp, tp) = q, p
        (rq, cq), (rp, cp) = (np.frombuffer(w, np.int32).reshape(2, -1) for w in (wq, wp))
        tq, tp = np.frombuffer(tq, np.int64), np.frombuffer(tp, np.int64)
        order = np.argsort(tq, kind="stable")
        own, starts, lengths = np.unique(tq[order], return_index=True, return_counts=True)
        rq, cq = rq[order], cq[order].astype(np.float64)
        out = np.zeros((nq, np_))
        if len(own):
            at = np.minimum(np.searchsorted(own, tp), len(own) - 1)
            met = own[at] == tp
            at, rp, cp = at[met], rp[met].astype(np.int64), cp[met].astype(np.float64)
            often = lengths >= max(2, FREQUENT * nq)
            often[np.argsort(-lengths, kind="stable")[MOST_FREQUENT:]] = False
            if often.any():
                place = np.cumsum(often) - 1
                term = np.repeat(np.arange(len(own)), lengths)
                of_q, of_p = often[term], often[at]
                a, b = np.zeros((nq, int(often.sum()))), np.zeros((int(often.sum()), np_))
                a[rq[of_q], place[term[of_q]]] = cq[of_q]
                b[place[at[of_p]], rp[of_p]] = cp[of_p]
                out += a @ b
                at, rp, cp = at[~of_p], rp[~of_p], cp[~of_p]
            pairs = np.cumsum(lengths[at])
            cuts = np.append(np.searchsorted(pairs, np.arange(0, int(pairs[-1]) if len(pairs) else 0, MOST_PAIRS)), len(at))
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                n = lengths[at[x:y]]
                entry = _gathered(np.arange(len(rq)), starts[at[x:y]], n)
                out += np.bincount(rq[entry] * np.int64(np_) + np.repeat(rp[x:y], n), cq[entry] * np.repeat(cp[x:y], n), nq * np_).reshape(nq, np_)
        out[out == 0] = -np.inf
        return out

    keeps_unscored = False


def packed(rows: DataFrame, row_id: str, vector: Column, on: Sequence[str], kind, most: int) -> DataFrame:
    """Blocks of at most `most` rows with equal columns `on`, which are not null: ids, kind, counts, data."""
    bounded_batches(rows.sparkSession)
    known = rows.select(*on, row_id, vector.alias("_vector")).dropna(subset=list(on)) if on else rows.select(row_id, vector.alias("_vector"))
    schema = StructType([*[known.schema[c] for c in on], StructField("ids", ArrayType(known.schema[row_id].dataType)), StructField("kind", IntegerType()), StructField("counts", BinaryType()), StructField("data", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, numbers = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                held.append(batch.slice(at, 1024))
                rows, numbers = rows + held[-1].num_rows, numbers + len(held[-1].column("_vector").flatten())
                if rows >= HELD_ROWS or numbers >= HELD_NUMBERS:
                    yield from blocks(held)
                    held, rows, numbers = [], 0, 0
        if held:
            yield from blocks(held)

    def blocks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in pa.Table.from_batches(held).combine_chunks().to_batches():
            values, starts, sizes = _lists(own.column("_vector"))
            kinds = kind.kinds(sizes)
            codes = _codes(own, on)
            order = np.lexsort((kinds, codes))
            codes = codes[order]
            edge = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (kinds[order][1:] != kinds[order][:-1]), [True])))
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                for a in range(x, y, most):
                    rows = order[a : min(a + most, y)]
                    counts, data = kind.pack(values, starts[rows], sizes[rows])
                    ids = own.column(row_id).take(pa.array(rows))
                    columns = [own.column(c).take(pa.array(rows[:1])) for c in on]
                    yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), ids), pa.array([int(kinds[rows[0]])], pa.int32()), pa.array([counts], pa.binary()), pa.array([data], pa.binary())], names=[*on, "ids", "kind", "counts", "data"])

    return known.mapInArrow(run, schema)


def best_pairs(queries: DataFrame, points: DataFrame, limit: int, on: Sequence[str], kind, score: str) -> DataFrame:
    """query_id, point_id and score of the pairs that may be among the best `limit` of a question. queries, points: `packed`."""
    q = F.broadcast(queries.withColumnsRenamed({c: f"q_{c}" for c in ("ids", "kind", "counts", "data")}))
    pairs = points.join(q, list(on)) if on else points.crossJoin(q)
    names = [f"{s}{c}" for s in ("q_", "") for c in ("ids", "kind", "counts", "data")]
    id_of = lambda df: df.schema["ids"].dataType.elementType
    schema = StructType([StructField("query_id", id_of(queries)), StructField("point_id", id_of(points)), StructField(score, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(c)[i] for c in names]
                sides = [(len(s[0].values), s[1].as_py(), s[2].as_py(), s[3].as_py()) for s in (row[:4], row[4:])]
                scores = kind.scores(*sides)
                # Spark's order: NaN before all numbers, null (no score) after them.
                key = np.where(np.isnan(scores), np.inf, scores)
                if key.shape[1] > limit:
                    least = -np.partition(-key, limit - 1, axis=1)[:, limit - 1]
                    keep = key >= np.where(np.isfinite(least), least - SLACK, least)[:, None]
                else:
                    keep = np.ones(key.shape, bool)
                if not kind.keeps_unscored:
                    keep &= key > -np.inf
                x, y = np.nonzero(keep)
                found = scores[x, y]
                yield pa.RecordBatch.from_arrays([row[0].values.take(pa.array(x)), row[4].values.take(pa.array(y)), pa.array(found, pa.float64(), mask=found == -np.inf)], names=["query_id", "point_id", score])

    return pairs.select(*names).mapInArrow(run, schema)
