"""Small files in any store that Spark reads, through Hadoop's file systems."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def full(self, name: str) -> str:
        return f"{self.root}/{name}".rstrip("/")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.full(name)))

    def names(self, name: str) -> list[str]:
        p = self._path(self.full(name))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._path(self.full(name)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.full(name)))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commit(self, name: str, data: str | bytes) -> bool:
        """Write a file under a name that only one writer can create; False if it exists (another writer was first).

        The file system's own create-without-overwrite decides, so two writers can't both succeed where it is atomic.
        """
        try:
            out = self._fs.create(self._path(self.full(name)), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                return False
            raise
        out.write(bytearray(data.encode() if isinstance(data, str) else data))
        out.close()
        return True

    def cut(self, name: str, length: int) -> None:
        """Keep a file's first length bytes."""
        stream = self._fs.open(self._path(self.full(name)))
        try:
            data = bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))[:length]
        finally:
            stream.close()
        staged = f"{name}.cut"
        self.remove(staged)
        self.commit(staged, data)
        self.remove(name)
        self.rename(staged, name)

    def rename(self, a: str, b: str) -> None:
        if not self._fs.rename(self._path(self.full(a)), self._path(self.full(b))):
            raise OSError(f"cannot rename {a} to {b}")

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(self.full(name)), True)
