"""Structured Streaming: continuous ingest by keyed merge, and windowed latencies."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noteloom.operators.points import KEY, upsert
from noteloom.session import delete_path, path_exists


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type; rows later than the watermark are dropped."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("slowest")).select(F.col("w.start").alias("start"), "event_type", "n", "total", "slowest")


def newest(points: DataFrame, version: str | None = None) -> DataFrame:
    """One row per key: the one with the largest version; rows of one version are ordered by their content."""
    order = [F.desc(version)] if version else []
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(*order, F.xxhash64(*points.columns)))
    return points.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def ingest_stream(points: DataFrame, table: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, version: str | None = None) -> StreamingQuery:
    """Merge a stream of points into a Parquet table by key. Each batch rewrites the tenants it touches from a staged
    copy, so replaying a batch leaves the same table. version: a column whose largest value wins within a batch."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = newest(transform(batch) if transform else batch, version).persist()
        staged = f"{table}-staged-{uuid.uuid4().hex}"  # of this batch alone
        merged = fresh
        if path_exists(spark, table):
            stored = spark.read.schema(fresh.schema).parquet(table).join(fresh.select("tenant_id").distinct(), "tenant_id", "left_semi")
            merged = upsert(stored, fresh)
        merged.write.mode("overwrite").parquet(staged)
        spark.read.schema(fresh.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id").parquet(table)
        delete_path(spark, staged)
        fresh.unpersist()

    return points.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
