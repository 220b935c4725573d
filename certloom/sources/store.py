"""Small files in whatever file system the dataset lies in, through Spark's own Hadoop client."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    """Lists, reads, writes and deletes under a root; for manifests and the like, not for rows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def path(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.path(name)))

    def names(self, folder: str) -> list[str]:
        where = self._path(self.path(folder))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def size(self, name: str) -> int:
        """Bytes of a file or of all files in a folder."""
        where = self._path(self.path(name))
        return self._fs.getContentSummary(where).getLength() if self._fs.exists(where) else 0

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.path(name)))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str, overwrite: bool = False) -> None:
        """Writes a whole file; visible by one rename, which replaces the old file or, without overwrite, fails over one."""
        jvm, target = self.spark.sparkContext._jvm, self._path(self.path(name))
        part = self._path(f"{self.path(name)}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(part, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = jvm.org.apache.hadoop.fs.Options
        how = self.spark.sparkContext._gateway.new_array(options.Rename, 1)
        how[0] = options.Rename.OVERWRITE if overwrite else options.Rename.NONE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(self._fs.makeQualified(part), self._fs.makeQualified(target), how)
        except Py4JJavaError as e:
            self._fs.delete(part, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise FileExistsError(self.path(name)) from None
            raise

    def room(self) -> tuple[int, int]:
        """(total, used) bytes of the volume; (0, 0) if the file system does not tell."""
        status = self._fs.getStatus(self._path(self.root))
        total = status.getCapacity()
        return (total, status.getUsed()) if 0 < total < 2**62 else (0, 0)

    def read_json(self, name: str) -> dict:
        return json.loads(self.read(name))

    def write_json(self, name: str, value: dict, overwrite: bool = False) -> None:
        self.write(name, json.dumps(value, indent=1, sort_keys=True), overwrite)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.path(name)), True)
