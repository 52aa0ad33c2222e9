"""A vault as a partitioned source: folders are partitions, listed in tasks through the file system of their path.

`spark.read.format("noteloom_vault").option("root", root)` gives path (relative), link and folder of everything below a
root but what dot folders hold. Links are listed, never followed; object stores have none.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME, LISTING = "noteloom_vault", "path string, link boolean, folder boolean"
#: Folders that the driver looks for, one level after the other, before it deals them out, and rows of a batch.
ENOUGH, LEVELS, ROWS = 32, 3, 10_000


def is_local(root: str) -> bool:
    return "://" not in root or root.startswith("file://")


def local(root: str) -> str:
    return root.removeprefix("file://")


def inside(root: str, folder: str) -> list[tuple[str, bool, bool]]:
    """(relative path, link, folder) of what lies directly in a folder; dot folders are passed over."""
    prefix = folder + "/" if folder else ""
    if is_local(root):
        with os.scandir(os.path.join(local(root), folder)) as found:
            out = [(prefix + e.name, e.is_symlink(), e.is_dir()) for e in found]
    else:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        found = system.get_file_info(fs.FileSelector(f"{base.rstrip('/')}/{folder}".rstrip("/")))
        out = [(prefix + f.base_name, False, f.type == fs.FileType.Directory) for f in found]
    return [(p, link, is_folder) for p, link, is_folder in out if not (is_folder and p.rpartition("/")[2].startswith("."))]


def open_file(root: str, path: str):
    """A file of a vault for reading bytes, and when it was modified, in seconds."""
    if is_local(root):
        full = os.path.join(local(root), path)
        return open(full, "rb"), os.path.getmtime(full)  # noqa: SIM115 - the caller closes it
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root)
    full = f"{base.rstrip('/')}/{path}"
    changed = system.get_file_info(full).mtime
    return system.open_input_stream(full), changed.timestamp() if changed else 0.0


class Part(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Part]:
        """The upper folders alone, the ones below them with all that they hold."""
        flat, level = [], [""]
        for _ in range(LEVELS):
            below = [p for folder in level for p, link, is_folder in inside(self.root, folder) if is_folder and not link]
            flat += level
            level = below
            if len(level) >= ENOUGH or not level:
                break
        return [Part(f, False) for f in flat] + [Part(f, True) for f in level]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        waiting, rows = [partition.folder], []
        while waiting:
            found = inside(self.root, waiting.pop())
            rows += found
            if partition.deep:
                waiting += [p for p, link, is_folder in found if is_folder and not link]
            if len(rows) >= ROWS:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple[str, bool, bool]]) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.bool_(), pa.bool_()))]
        return pa.RecordBatch.from_arrays(columns, ["path", "link", "folder"])


class VaultListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> Reader:
        return Reader(self.options["root"])


def listing(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(VaultListing)
    return spark.read.format(NAME).option("root", root).load()
