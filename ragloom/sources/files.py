"""Small files beside the data, through Spark's own file systems, so that a path means the same on every machine."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


class Files:
    """Names, reading, exclusive creation and deletion below a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.folder = folder.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.gateway = spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, name: str = "") -> list[str]:
        path = self._path(name)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self._path(name), True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether the file could be made; false if it is there already. Readers see the whole file or none."""
        part = f"{name}.{time.time_ns()}.tmp"
        self.write(part, text)
        known = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        options = self.gateway.new_array(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename") and getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            known.rename(self.fs.makeQualified(self._path(part)), self.fs.makeQualified(self._path(name)), options)
            return True
        except Exception as error:
            self.delete(part)
            if "FileAlreadyExistsException" in str(error):
                return False
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength()

    def age_hours(self, name: str) -> float:
        return time.time() / 3600 - self.fs.getFileStatus(self._path(name)).getModificationTime() / 3.6e6
