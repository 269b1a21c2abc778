"""A small versioned pointer beside immutable folders: readers see one whole state, writers change it in one step."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has changed the state since it was read."""


class Manifest:
    """Versions of a JSON object under ``root``/_manifest, one file each; the highest number holds.

    A version is written beside its place and renamed to it, which fails if it is taken: one rename, on file systems that have
    it in one step, is all that changes what readers see.
    """

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self.root = root.rstrip("/")
        self.folder = f"{self.root}/_manifest"
        self.fs = self.at(self.root).getFileSystem(self._conf)

    def at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _numbers(self) -> list[int]:
        if not self.fs.exists(self.at(self.folder)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.at(self.folder))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d{12})\.json", n)))

    def read(self) -> tuple[int, dict]:
        """The version in force and what it says; 0 and nothing before the first."""
        numbers = self._numbers()
        if not numbers:
            return 0, {}
        return numbers[-1], json.loads(self.text(f"{self.folder}/{numbers[-1]:012d}.json"))

    def text(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, path: str, text: str) -> None:
        stream = self.fs.create(self.at(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def commit(self, after: int, says: dict) -> int:
        """The next version, which says ``says``, if ``after`` is still in force; else Conflict."""
        if self.read()[0] != after:
            raise Conflict(f"version {after} is no longer in force")
        number = after + 1
        place = f"{self.folder}/{number:012d}.json"
        beside = f"{self.folder}/.{self._jvm.java.util.UUID.randomUUID().toString()}"
        self.put(beside, json.dumps(says, sort_keys=True))
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self._conf).rename(self.at(beside), self.at(place), options)
        except Exception as e:
            self.fs.delete(self.at(beside), False)
            raise Conflict(f"version {number} is taken") from e
        return number

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)
