"""Files of a store, on any file system that Hadoop knows."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *names: str) -> str:
        return "/".join((self.root, *names))

    def names(self, *at: str) -> list[str]:
        path = self._Path(self.path(*at))
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def delete(self, *names: str) -> None:
        self.fs.delete(self._Path(self.path(*names)), True)

    def read_json(self, *names: str) -> dict:
        stream = self.fs.open(self._Path(self.path(*names)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _part(self, data: bytes, names: tuple[str, ...]):
        part = self._Path(self.path(*names[:-1], f".{names[-1]}.{uuid.uuid4().hex}"))
        stream = self.fs.create(part)
        try:
            stream.write(data)
            stream.hsync()
        finally:
            stream.close()
        return part

    def write_bytes(self, data: bytes, *names: str) -> None:
        """A whole file, written under another name and then renamed over what is there."""
        self._replace(self._part(data, names), self._Path(self.path(*names)))

    def _replace(self, part, target) -> None:
        if not self.fs.rename(part, target):
            # file systems that don't rename over a file
            self.fs.delete(target, False)
            if not self.fs.rename(part, target):
                raise OSError(f"can't write {target}")

    def replace(self, part: str, *names: str) -> None:
        """Renames a file of this folder over what is there."""
        self._replace(self._Path(self.path(part)), self._Path(self.path(*names)))

    def make(self, *names: str) -> None:
        self.fs.mkdirs(self._Path(self.path(*names)))

    def uri(self, *names: str) -> str:
        """The path with its scheme, as Python workers open it."""
        return self.fs.makeQualified(self._Path(self.path(*names))).toString()

    def write_json(self, value: dict, *names: str) -> bool:
        """All or nothing: a file of another name is written and then renamed. False if the name is taken."""
        target, part = self._Path(self.path(*names)), self._part(json.dumps(value, sort_keys=True).encode(), names)
        if self.fs.exists(target) or not self.fs.rename(part, target):
            self.fs.delete(part, False)
            return False
        return True
