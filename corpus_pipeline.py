"""Corpus pipeline: toxicity, near duplicates, benchmark passages, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Stages that filter keep every document they do not
reject, null ids and texts included. Ties between copies go to the smallest id; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm import decontamination, jaccard_join, pii, sentencepieces, toxicity, url_filter
from noteloom.llm.common import materialize, scratch, stage_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go."""
    model = toxicity.ToxicityModel.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(model.score(F.coalesce("text", F.lit(""))) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays, that of the smallest doc_id. Rows are told apart by id and set of shingles, so a
    row whose id repeats stays if nothing like its text does; of rows with one id and set (without words: one id and text)
    one stays. Documents without an id stay.

    Which ids go is told by a Bloom cascade over all ids, which is exact for them, so that no text is shuffled for it; only
    rows whose ids repeat meet their decision by a join.
    """
    path = stage_path(spark, "components")
    with scratch(spark):
        jaccard_join.ngram_components(docs, sets=True).write.parquet(path)
    linked = spark.read.parquet(path)
    ids = materialize(linked.groupBy(F.col("doc_id").alias("key")).agg(F.max(F.col("doc_id") != F.col("component_id")).alias("listed"), F.count("*").alias("rows")), "ids")
    repeats = F.col("rows") > 1
    gone = url_filter.BloomCascade.build(ids.select("key", (F.col("listed") & ~repeats).alias("listed")))
    doc_id = F.col("doc_id").cast("long")
    kept = gone.add_listed(docs, doc_id, "_gone").where(F.col("doc_id").isNull() | ~F.col("_gone")).select(docs.columns)
    if ids.where(repeats).isEmpty():
        return kept
    several = url_filter.BloomCascade.build(ids.select("key", repeats.alias("listed"))).add_listed(kept, doc_id, "_repeats")
    once = several.where(F.col("doc_id").isNull() | ~F.col("_repeats")).select(docs.columns)
    # Of a component the row of the smallest id and, for that id, of the smallest fingerprint.
    first = linked.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id", "component").agg(F.min("print").alias("_print")).drop("component")
    first = first.join(ids.where(repeats).select(F.col("key").alias("doc_id")), "doc_id", "left_semi")
    rest = jaccard_join.with_prints(several.where(F.col("doc_id").isNotNull() & F.col("_repeats")).select(docs.columns), "_print", "_plain")
    rest = rest.join(first.withColumnRenamed("doc_id", "_id"), (F.col("_id") == doc_id) & first["_print"].eqNullSafe(rest["_print"]), "left_semi")
    return once.unionByName(rest.dropDuplicates(["doc_id", "_print", "_plain"]).select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets."""
    return pii.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, exact."""
    return sentencepieces.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("sentencepiece", encode_pieces),
]

#: Learned scores, span classification and piece ids have no SQL form; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
