"""Small files of the shared file system, from the driver: manifests and leases."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Names, contents and creation of the files below a folder, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm, self._folder = spark._jvm, folder.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{name}" if name else self._folder)

    def names(self, name: str = "") -> list[str]:
        """Names directly below, none where there is no such folder."""
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(name))) if self._fs.exists(self._path(name)) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def written(self, name: str) -> float:
        """When a file was written, in seconds."""
        return self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def create(self, name: str, text: str) -> bool:
        """Create a file unless it is there: of several that try at once one succeeds."""
        try:
            stream = self._fs.create(self._path(name), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def publish(self, name: str, text: str) -> None:
        """Make a whole file appear in one step, where none may be yet."""
        draft = f".{uuid.uuid4().hex}"
        self.create(draft, text)
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self._jvm.java.lang.reflect.Array.newInstance(options.NONE.getClass(), 1)
        kinds[0] = options.NONE
        self._fs.mkdirs(self._path(name).getParent())
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._path(draft), self._path(name), kinds)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
