"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.session import BATCH_BYTES, bounded_batches  # noqa: F401 - also for the operators


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares; a temporary one only for a session in one process (tests) that names none."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all hosts share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="noteloom-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


@contextmanager
def set_for_now(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Session settings for the actions inside."""
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of a partition whose worker drops what other functions kept, and gives freed memory back when it is
    done: workers live for many stages."""

    def outer(batches: Iterator) -> Iterator:
        drop_kept()
        yield from run(batches)
        release_memory()

    return outer


def flagged(name: str) -> list[Column]:
    """A long column for pandas, which would read a nullable one as floats: the number, 0 for null, and whether it is null."""
    value = F.col(name).cast("long")
    return [F.coalesce(value, F.lit(0).cast("long")).alias(name), value.isNull().alias(f"no_{name}")]


def nullable(batch: pd.DataFrame, name: str) -> pd.arrays.IntegerArray:
    """The column back from its `flagged` form, exact for all longs."""
    return pd.arrays.IntegerArray(batch[name].to_numpy(np.int64), batch[f"no_{name}"].to_numpy(bool))


#: What a worker built last.
_KEPT: dict[tuple, object] = {}


def kept(key: tuple, build: Callable[[], object]) -> object:
    """What `build` gives, held for the worker's next tasks until it meets another key or a trimmed function."""
    if key not in _KEPT:
        drop_kept()
        _KEPT[key] = build()
    return _KEPT[key]


def drop_kept() -> None:
    _KEPT.clear()


def release_memory() -> None:
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc
        trim(0)


class _Scopes(threading.local):
    def __init__(self) -> None:
        self.open: list[list[str]] = []


_SCOPES = _Scopes()


#: Tables that a later action may still read, and the file system settings to delete them with when the driver ends.
_LEFT: list[tuple[object, object]] = []


def stage_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; it is deleted with its scope, or when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES.open:
        _SCOPES.open[-1].append(path)
    else:
        _LEFT.append((spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()))
    return path


@atexit.register
def _delete_left() -> None:
    while _LEFT:
        target, settings = _LEFT.pop()
        try:
            target.getFileSystem(settings).delete(target, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables written inside once their result is stored elsewhere."""
    _SCOPES.open.append([])
    try:
        yield
    finally:
        for path in _SCOPES.open.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write to a Parquet table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys with more than one in HOT_KEYS of all rows are hot, so there are fewer than HOT_KEYS of them.
HOT_KEYS, LEAST_HOT = 10_000, 100


def hot_limit(rows: int) -> int:
    """Rows that a key may have without being hot."""
    return max(rows // HOT_KEYS, LEAST_HOT)


def join_hot_keys(rows: DataFrame, totals: DataFrame, keys: list[str], count: str, add: list[str]) -> DataFrame:
    """rows with the columns `add` of totals (one row per key, with the number of its rows in `count`); null without one.

    Rows of hot keys meet a broadcast of at most HOT_KEYS totals and are not shuffled; the others are joined by key.
    """
    n = totals.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) > hot_limit(n)
    hot, other = totals.where(is_hot), totals.where(~is_hot)
    named = [F.col(c).alias(f"_right_{c}") for c in keys]
    if hot.isEmpty():
        return rows.join(totals.select(*keys, *add), keys, "left").select(*rows.columns, *add)
    first = rows.join(F.broadcast(hot.select(*named, *[F.col(c).alias(f"_hot_{c}") for c in add], F.lit(True).alias("_hot"))), [F.col(c) == F.col(f"_right_{c}") for c in keys], "left")
    first = materialize(first.drop(*[f"_right_{c}" for c in keys]), "hot")
    done = first.where("_hot").select(*rows.columns, *[F.col(f"_hot_{c}").alias(c) for c in add])
    rest = first.where(F.col("_hot").isNull()).select(*rows.columns)
    return done.unionByName(rest.join(other.select(*keys, *add), keys, "left").select(*rows.columns, *add))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """A pyarrow filesystem and the path in it, for file://, hdfs://, s3:// and gs:// folders."""
    from pyarrow import fs

    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def block_batches(folder: str, block: int, columns: list[str]) -> Iterator:
    """Rows of a block from the Parquet files of a folder, which are sorted by block; only the row groups near it are read."""
    import pyarrow.parquet as pq
    from pyarrow import compute, fs

    files, root = filesystem(folder)
    for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if not info.path.endswith(".parquet"):
            continue
        with files.open_input_file(info.path) as source:
            file = pq.ParquetFile(source)
            place = file.schema_arrow.names.index("block")
            near = [i for i in range(file.num_row_groups) if (s := file.metadata.row_group(i).column(place).statistics) is None or s.min <= block <= s.max]
            for batch in file.iter_batches(batch_size=20_000, row_groups=near, columns=["block", *columns]):
                yield batch.filter(compute.equal(batch.column("block"), block))
