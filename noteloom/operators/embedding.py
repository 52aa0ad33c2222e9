"""Pluggable embedders: batches go through an iterator, the model loads once per worker, a bad vector fails the task."""

from __future__ import annotations

import math
import time
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions.text import words
from noteloom.functions.vectors import embedding_error, hash_embedding
from noteloom.operators.batches import bounded_batches
from noteloom.operators.postings import SPARSE, checked
from noteloom.schemas import EmbedderMismatch, Handshake

Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]


#: What an applied state holds about the model of a collection.
STATE_KEYS = {"model", "handshake"}


def verify(own: Handshake, applied: dict | None, model: str) -> bool:
    """Before anything is embedded: whether the embedder is the one the collection was built with. False if nothing is
    recorded yet (unverified); a difference raises."""
    if applied is None:
        return False
    if applied["model"] != model:
        raise EmbedderMismatch(f"the stored vectors come from {applied['model']}, not {model}")
    own.require(Handshake(**applied["handshake"]))
    return True


def probe(vectors: Sequence[Sequence[float]], sparse: Sequence[dict] | None = None, slack: float = 1e-3) -> None:
    """What an embedder must show at its start: unit vectors, and sparse vectors that are not empty."""
    for v in vectors:
        if abs(math.sqrt(sum(x * x for x in v)) - 1) > slack:
            raise ValueError("the embedder returns vectors that are not of unit length")
    if sparse is not None and not all(sparse):
        raise ValueError("the embedder returns empty sparse vectors")


def embed(chunks: DataFrame, load: Callable[[], Embed], width: int, batch: int = 32, attempts: int = 3, delay: float = 0.5, in_flight: int = 2) -> DataFrame:
    """Adds `dense`. `load` runs once per worker; `in_flight` batches go out at a time. A batch is tried `attempts` times
    with a delay that doubles, then its task fails: a note gets all its vectors or none. A worker holds texts of bounded bytes."""
    bounded_batches(chunks.sparkSession)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()

        def once(texts: list[str]) -> list[list[float]]:
            for last in range(attempts):
                try:
                    out = [list(map(float, v)) for v in model(texts)]
                    break
                except OSError:
                    if last == attempts - 1:
                        raise
                    time.sleep(delay * 2**last)
            if len(out) != len(texts) or any(len(v) != width for v in out):
                raise ValueError("the embedder returned other vectors than asked for")
            return out

        with ThreadPoolExecutor(in_flight) as pool:
            for series in batches:
                texts = series.tolist()
                parts = pool.map(once, (texts[at : at + batch] for at in range(0, len(texts), batch)))
                yield pd.Series([v for part in parts for v in part], dtype=object)

    return chunks.withColumn("dense", run(F.col("text")))


BOTH = f"struct<dense:array<double>,sparse:{SPARSE}>"


def embed_both(chunks: DataFrame, load: Callable[[], Callable[[Sequence[str]], Sequence[tuple[Sequence[float], Mapping[int, float]]]]], width: int, batch: int = 32, attempts: int = 3, delay: float = 0.5, in_flight: int = 2) -> DataFrame:
    """Adds `dense` and `sparse`, from a model that gives both for each text. A vector that may not be stored fails the
    task: one of another width, not finite or zero, or a sparse one that is empty, repeats an id or has an odd weight."""
    bounded_batches(chunks.sparkSession)

    @F.pandas_udf(BOTH)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        with ThreadPoolExecutor(in_flight) as pool:
            for series in batches:
                texts = series.tolist()
                parts = pool.map(lambda own: _tried(model, own, attempts, delay), (texts[at : at + batch] for at in range(0, len(texts), batch)))  # noqa: B023
                both = [v for part in parts for v in part]
                if len(both) != len(texts):
                    raise ValueError("the embedder returned other vectors than asked for")
                sparse = [[{"id": int(i), "weight": float(w)} for i, w in sorted(own.items())] for _, own in both]
                yield pd.DataFrame({"dense": pd.Series([list(map(float, d)) for d, _ in both], dtype=object), "sparse": pd.Series(sparse, dtype=object)})

    made = chunks.withColumn("_both", run(F.col("text")))
    problem = embedding_error(F.col("_both.dense"), width)
    dense = F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit("dense vector: "), problem)).cast("array<double>")).otherwise(F.col("_both.dense"))
    return made.withColumns({"dense": dense, "sparse": checked(F.col("_both.sparse"))}).drop("_both")


def _tried(model: Callable, texts: Sequence[str], attempts: int, delay: float):
    for last in range(attempts):
        try:
            return list(model(texts))
        except OSError:
            if last == attempts - 1:
                raise
            time.sleep(delay * 2**last)


def embed_by_hash(chunks: DataFrame, width: int = 64) -> DataFrame:
    """Deterministic vectors without a model, in column arithmetic."""
    return chunks.withColumn("dense", hash_embedding(F.col("text"), width))


def sparse_by_hash(chunks: DataFrame) -> DataFrame:
    """Adds `sparse`: how often each word occurs, under a number of the word."""
    bounded_batches(chunks.sparkSession)

    @F.pandas_udf(SPARSE)
    def run(ids: pd.Series) -> pd.Series:
        return pd.Series([[{"id": i, "weight": float(n)} for i, n in sorted(Counter(own.tolist()).items())] for own in ids], dtype=object)

    return chunks.withColumn("sparse", run(F.transform(words(F.col("text")), lambda w: F.xxhash64(w))))


def hash_question(spark: SparkSession, text: str, width: int = 64) -> tuple[list[float], dict[int, float]]:
    """Both vectors of one text, computed with the plan: a table of constants needs no job."""
    row = spark.sql("SELECT * FROM VALUES (:text) AS t(text)", args={"text": text})
    ids = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    counted = F.transform(F.array_distinct("ids"), lambda i: F.struct(i.alias("id"), F.size(F.filter("ids", lambda x: x == i)).alias("n")))
    got = row.select(hash_embedding(F.col("text"), width).alias("dense"), ids.alias("ids")).select("dense", counted.alias("sparse")).first()
    return list(got.dense), {s.id: float(s.n) for s in got.sparse}


def both_by_hash(chunks: DataFrame, width: int = 64) -> DataFrame:
    return sparse_by_hash(embed_by_hash(chunks, width))
