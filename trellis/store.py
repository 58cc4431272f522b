"""Versions of a graph in a folder: written aside, then taken over at once; snapshots and a lock for builds."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Busy(Exception):
    """Another build holds the lock."""


class GraphStore:
    """Tables below ``root``; the file ``current`` names the version that readers see."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    @property
    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    @property
    def version(self) -> str | None:
        if not self._fs.exists(self._path("current")):
            return None
        stream = self._fs.open(self._path("current"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip() or None
        finally:
            stream.close()

    def read(self, table: str) -> DataFrame:
        if self.version is None:
            raise FileNotFoundError(f"no graph in {self.root}")
        return self.spark.read.parquet(f"{self.root}/{self.version}/{table}")

    def write(self, tables: dict[str, DataFrame], keep: int = 2) -> str:
        """A new version of all tables.  Readers see the old one until every table is written; a failure changes nothing."""
        version = f"v{time.time_ns():020}-{uuid.uuid4().hex[:6]}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{version}/{name}")
        self._point(version)
        old = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("")) if s.isDirectory() and s.getPath().getName().startswith("v"))
        for name in old[:-keep]:
            self._fs.delete(self._path(name), True)
        return version

    def _point(self, version: str) -> None:
        new = self._path(f".current-{uuid.uuid4().hex[:8]}")
        out = self._fs.create(new, True)
        out.write(bytearray(version.encode()))
        out.close()
        if not self._fs.rename(new, self._path("current")):  # some file systems rename onto nothing only
            self._fs.delete(self._path("current"), False)
            self._fs.rename(new, self._path("current"))

    @contextmanager
    def lock(self, wait: float | None = None) -> Iterator[None]:
        """One build at a time; waits so many seconds (for ever by default) and then raises ``Busy``."""
        until = None if wait is None else time.monotonic() + wait
        self._fs.mkdirs(self._path(""))
        while not self._fs.createNewFile(self._path("lock")):
            if until is not None and time.monotonic() >= until:
                raise Busy(self.root)
            time.sleep(0.05)
        try:
            yield
        finally:
            self._fs.delete(self._path("lock"), False)

    def seed_from(self, other: GraphStore) -> bool:
        """A copy of the current version of ``other``, if there is one, nothing builds it, and there is no graph here yet."""
        if other.root == self.root or other.version is None or self.version is not None:
            return False
        try:
            with other.lock(wait=0):
                version = other.version
                util = self._jvm.org.apache.hadoop.fs.FileUtil
                if not util.copy(other._fs, other._path(version), self._fs, self._path(version), False, self.spark.sparkContext._jsc.hadoopConfiguration()):
                    return False
        except Busy:
            return False
        self._point(version)
        return True
