"""Small files of a folder on any file system that Spark can reach: read, create once, replace in one step, list."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Exists(RuntimeError):
    """A file that may be created only once is there already."""


class Folder:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._hadoop.fs.Path(self.root).getFileSystem(self._conf)

    def path(self, name: str = ""):
        return self._hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self.path(name))

    def names(self, pattern: str) -> list[str]:
        """Paths under the folder that match a glob, relative to it, in order."""
        found = self._fs.globStatus(self.path(pattern)) or []
        depth = pattern.count("/") + 1
        return sorted("/".join(str(f.getPath().toString()).split("/")[-depth:]) for f in found)

    def read(self, name: str) -> str | None:
        """The text of a file; None if it is not there."""
        try:
            stream = self._fs.open(self.path(name))
        except Py4JJavaError as e:
            if "FileNotFoundException" in str(e.java_exception):
                return None
            raise
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file; Exists if another was first."""
        try:
            stream = self._fs.create(self.path(name), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                raise Exists(name) from e
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, name: str, text: str, temporary: str) -> None:
        """Write beside the target, then rename over it, which readers see as one step on file systems with such a rename."""
        self.delete(temporary)
        self.create(temporary, text)
        rename = getattr(self._hadoop.fs, "Options$Rename").OVERWRITE
        options = self.spark._sc._gateway.new_array(getattr(self._hadoop.fs, "Options$Rename"), 1)
        options[0] = rename
        source, target = self._fs.makeQualified(self.path(temporary)), self._fs.makeQualified(self.path(name))
        self._hadoop.fs.FileContext.getFileContext(source.toUri(), self._conf).rename(source, target, options)

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)
