"""Stored sparse vectors as posting lists, and ranked search over them with MaxScore bounds.

A posting is (tenant_id, bucket, term, point_id, seq, weight); seq is the run that wrote the point, so postings of an older
version of a point meet no stored row and need no deletion. Lists lie in buckets of terms, sorted by term and falling
weight; `bounds` has the largest weight of each term. A search reads the lists of its terms only.

MaxScore: the terms of a question in the order of their largest possible share. The lists of the first ones give a score
that the answer reaches at least; terms whose shares together stay below it are no reason to look at a point, so their lists
are met only by points that the others brought and that can still reach it. The result is that of the whole dot product.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions.vectors import sparse_error

#: A sparse vector of a point: ascending ids with positive weights.
SPARSE = "array<struct<id:bigint,weight:double>>"
POSTINGS = "term bigint, point_id string, seq bigint, weight double, run string, tenant_id string, bucket int"
BOUNDS = "term bigint, n bigint, largest double, run string, tenant_id string, bucket int"
BUCKETS = 16
#: Share of a question's terms whose lists give the first bound, two terms at least, and what rounding may move a score by.
HEAD_SHARE, LEAST_HEAD, SLACK = 0.75, 2, 1e-6
#: Runs of postings of a tenant after which they are written anew.
MOST_RUNS = 8


def term_bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def checked(sparse: Column) -> Column:
    """The vector, or an error that names what is wrong with it."""
    problem = sparse_error(F.transform(sparse, lambda p: p["id"]), F.transform(sparse, lambda p: p["weight"]))
    negative = F.when(F.exists(sparse, lambda p: p["weight"] < 0), "negative")
    bad = F.when(sparse.isNull(), "missing").otherwise(F.coalesce(problem, negative))
    return F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("sparse vector: "), bad)).cast(SPARSE)).otherwise(sparse)


def postings_of(points: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """points: tenant_id, point_id, seq, sparse."""
    rows = points.select("tenant_id", "point_id", "seq", F.explode("sparse").alias("s")).select("tenant_id", F.col("s.id").alias("term"), "point_id", "seq", F.col("s.weight").alias("weight"))
    return rows.withColumn("bucket", term_bucket(F.col("term"), buckets))


def in_lists(postings: DataFrame) -> DataFrame:
    """Sorted for writing; the list of a frequent term may lie in several files."""
    return postings.repartitionByRange("tenant_id", "bucket", "term", "point_id").sortWithinPartitions("tenant_id", "bucket", "term", F.desc("weight"), "point_id")


def bounds_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("tenant_id", "bucket", "term").agg(F.count("*").alias("n"), F.max("weight").alias("largest"))


Eligible = Callable[[DataFrame], DataFrame]


def _scored(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """Sums of the shares of the asked terms by question and point."""
    pairs = postings.join(F.broadcast(asked.select("query_id", "tenant_id", "term", F.col("weight").alias("asked"))), ["tenant_id", "term"])
    return pairs.groupBy("query_id", "point_id", "seq").agg(F.sum(F.col("weight") * F.col("asked")).alias("score"))


def with_shares(asked: DataFrame, bounds: DataFrame) -> DataFrame:
    """Terms of questions with `place` by falling share, and `rest`: the shares from there on."""
    largest = bounds.groupBy("tenant_id", "term").agg(F.max("largest").alias("largest"), F.sum("n").alias("n"))
    shares = largest.join(F.broadcast(asked), ["tenant_id", "term"]).withColumn("share", F.col("weight") * F.col("largest"))
    # Of equal shares the rarer term first: its list is shorter.
    order = Window.partitionBy("query_id").orderBy(F.desc("share"), "n", "term")
    after = Window.partitionBy("query_id").orderBy(F.desc("share"), "n", "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return shares.withColumns({"place": F.row_number().over(order), "rest": F.sum("share").over(after), "terms": F.count("*").over(Window.partitionBy("query_id"))})


def split_terms(asked: DataFrame, postings: DataFrame, bounds: DataFrame, limit: int, eligible: Eligible | None = None) -> DataFrame:
    """Terms of questions with the score that the answer reaches at least (`least`), and whether they are `needed`."""
    shares = with_shares(asked, bounds)
    first = _scored(postings, shares.where(F.col("place") <= F.greatest(F.lit(LEAST_HEAD), F.ceil(F.col("terms") * HEAD_SHARE))))
    first = eligible(first) if eligible else first
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    least = first.withColumn("rank", rank).where(F.col("rank") == limit).select("query_id", F.col("score").alias("least"))
    told = shares.join(F.broadcast(least), "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))  # one row per question of a block
    return told.withColumn("needed", F.col("rest") >= F.col("least") - SLACK)


def top_points(asked: DataFrame, postings: DataFrame, bounds: DataFrame, limit: int, eligible: Eligible | None = None) -> DataFrame:
    """query_id, point_id, sparse_score, sparse_rank of the best `limit` points of each question.

    asked: query_id, tenant_id, term, weight (positive), few enough to be broadcast (`retrieval.in_blocks`). postings:
    tenant_id, term, point_id, seq, weight. eligible: keeps the rows (query_id, point_id, seq) that may be answers.
    """
    told = split_terms(asked, postings, bounds, limit, eligible)
    beyond = told.groupBy("query_id").agg(F.first("least").alias("least"), F.coalesce(F.max(F.when(~F.col("needed"), F.col("rest"))), F.lit(0.0)).alias("beyond"))
    reached = _scored(postings, told.where("needed")).join(F.broadcast(beyond), "query_id").where(F.col("score") + F.col("beyond") >= F.col("least") - SLACK)
    reached = (eligible(reached) if eligible else reached).select("query_id", "point_id", "seq", "score")
    others = postings.join(F.broadcast(told.where(~F.col("needed")).select("query_id", "tenant_id", "term", F.col("weight").alias("asked"))), ["tenant_id", "term"])
    added = others.select("query_id", "point_id", "seq", (F.col("weight") * F.col("asked")).alias("more"))
    whole = reached.join(added.join(reached.select("query_id", "point_id", "seq"), ["query_id", "point_id", "seq"], "left_semi").groupBy("query_id", "point_id", "seq").agg(F.sum("more").alias("more")), ["query_id", "point_id", "seq"], "left")
    scored = whole.select("query_id", "point_id", F.round(F.col("score") + F.coalesce("more", F.lit(0.0)), 6).alias("sparse_score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sparse_score"), "point_id"))
    return scored.withColumn("sparse_rank", rank).where(F.col("sparse_rank") <= limit)


def visited(asked: DataFrame, postings: DataFrame, bounds: DataFrame, limit: int) -> DataFrame:
    """query_id, lists, needed, entries, visited: how many of a question's terms, and of the entries of their lists, are a
    reason to look at a point."""
    told = split_terms(asked, postings, bounds, limit)
    own = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0))
    return told.groupBy("query_id").agg(F.count("*").alias("lists"), own(F.col("needed"), F.lit(1)).alias("needed"), F.sum("n").alias("entries"), own(F.col("needed"), F.col("n")).alias("visited"))


def token_lists(rows: DataFrame, words: Column) -> tuple[DataFrame, DataFrame]:
    """Lists and bounds of distinct words, each of weight 1, so that a score is a number of shared words. rows: tenant_id,
    point_id."""
    own = rows.select("tenant_id", "point_id", F.lit(1).cast("bigint").alias("seq"), F.explode(F.transform(words, lambda w: F.xxhash64(w))).alias("term"))
    lists = own.withColumns({"bucket": term_bucket(F.col("term")), "weight": F.lit(1.0)})
    return lists, bounds_of(lists)


def top_by_words(asked: DataFrame, lists: DataFrame, bounds: DataFrame, limit: int) -> DataFrame:
    """Distinct shared words, best first, ties by point: rare words first, and words that are left when the k-th score is
    out of reach bring no new point. asked: query_id, tenant_id, term."""
    ranked = top_points(asked.withColumn("weight", F.lit(1.0)), lists, bounds, limit)
    return ranked.select("query_id", "point_id", F.col("sparse_score").cast("long").alias("score"), F.col("sparse_rank").alias("rank"))


def of_terms(postings: DataFrame, terms: Sequence[int], buckets: int = BUCKETS) -> DataFrame:
    """The lists of a few known terms: a filter that skips the row groups of all others."""
    return postings.where(F.col("term").isin(*[int(t) for t in terms]))


def buckets_of(spark, terms: Sequence[int], buckets: int = BUCKETS) -> list[int]:
    """Which buckets have these terms."""
    return sorted({r[0] for r in spark.createDataFrame([(int(t),) for t in terms], "term bigint").select(term_bucket(F.col("term"), buckets)).collect()}) if terms else []
