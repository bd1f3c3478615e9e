"""Small files on any Hadoop file system, from the driver: text, existence, atomic moves.

Spark writes the tables and models; what is left for the driver are a few bounded documents next to them. These go through
the session's Hadoop configuration, so a folder may be on any file system that Spark can write to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Storage:
    def __init__(self, spark: SparkSession):
        sc = spark.sparkContext
        self._jvm, self._gateway, self._conf = sc._jvm, sc._gateway, sc._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _system(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def qualified(self, path: str) -> str:
        """The path with scheme and authority, as Spark reports it."""
        return self._system(path).makeQualified(self._path(path)).toString()

    def exists(self, path: str) -> bool:
        return self._system(path).exists(self._path(path))

    def delete(self, path: str) -> None:
        self._system(path).delete(self._path(path), True)

    def make_folder(self, path: str) -> None:
        self._system(path).mkdirs(self._path(path))

    def empty_files(self, folder: str) -> list[str]:
        """Paths of the files without content below ``folder``; Spark's file scans leave them out."""
        found, files = [], self._system(folder).listFiles(self._path(folder), True)
        while files.hasNext():
            status = files.next()
            if status.getLen() == 0:
                found.append(status.getPath().toString())
        return found

    def read_text(self, path: str) -> str:
        stream = self._system(path).open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        system = self._system(path)
        if system.getUri().getScheme() == "file":  # without checksum files beside ours
            system = self._jvm.org.apache.hadoop.fs.FileSystem.getLocal(self._conf).getRawFileSystem()
        out = system.create(self._path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def move(self, source: str, target: str, replace: bool = False) -> None:
        """Renames in one step. Without ``replace`` an existing target is an error and keeps its content."""
        jvm = self._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.qualified(target)).toUri(), self._conf)
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        options = self._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE if replace else kind.NONE
        context.rename(self._path(self.qualified(source)), self._path(self.qualified(target)), options)

    def swap_text(self, path: str, text: str) -> None:
        """Replaces a document: readers see the old one or the new one, never a part."""
        beside = f"{path}.{uuid.uuid4().hex}"
        self.write_text(beside, text)
        self.move(beside, path, replace=True)
