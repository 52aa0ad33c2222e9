"""Batches of rows that go to Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of rows that a Python worker is sent at a time: long texts must not add up to a batch of any size.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, unless the session already has a smaller bound."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(setting).rstrip("bB") or 0) > BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))
