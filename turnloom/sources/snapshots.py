"""Versioned tables: readers see one whole version, writers publish by creating one file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from turnloom.sources.files import _fs


class Pointers:
    """The files ``current-<n>`` of a folder; what the one with the largest n holds counts.

    Names are the same for all writers, so pointing is the creation of one file, which fails if
    another writer has it already. A file without content is being written, or its writer died:
    its number stays taken, but it points at nothing. A writer that finds a larger number once its
    own file is written has been overtaken and is told so.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def taken(self) -> list[tuple[int, bool]]:
        """The numbers in use, and whether each has content."""
        fs, root = _fs(self.spark, self.path)
        if not fs.exists(root):
            return []
        files = [(x.getPath().getName(), x.getLen() > 0) for x in fs.listStatus(root)]
        return sorted((int(name.partition("-")[2]), full) for name, full in files if name.startswith("current-"))

    def held(self, n: int) -> str:
        fs, target = _fs(self.spark, f"{self.path}/current-{n:08d}")
        stream = fs.open(target)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def newest(self) -> str | None:
        full = [n for n, content in self.taken() if content]
        return self.held(full[-1]) if full else None

    def point(self, content: str, seen: list[tuple[int, bool]] | None = None) -> None:
        """Make ``content`` the newest; raises if numbers have come since ``seen``."""
        now = self.taken()
        if seen is not None and now != seen:
            raise RuntimeError("another version was published meanwhile")
        n = now[-1][0] + 1 if now else 0
        fs, target = _fs(self.spark, f"{self.path}/current-{n:08d}")
        try:
            stream = fs.create(target, False)
        except Exception as error:
            raise RuntimeError("another version was published meanwhile") from error
        stream.write(bytearray(content.encode()))
        stream.close()
        if self.taken()[-1][0] > n:
            raise RuntimeError("another version was published meanwhile")


class VersionedTables:
    """Named tables under ``path``. A version is a folder of Parquet tables; a pointer names the one
    that counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.pointers = Pointers(spark, path)

    def version(self) -> str | None:
        return self.pointers.newest()

    def read(self, table: str, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{version or self.version()}/{table}")

    def publish(self, tables: dict[str, DataFrame], expected: str | None = None) -> str:
        """Write ``tables`` as the next version. If the version is no longer ``expected``, raise."""
        made, seen = f"v{uuid.uuid4().hex}", self.pointers.taken()
        for name, rows in tables.items():
            rows.write.parquet(f"{self.path}/{made}/{name}")
        if expected is not None and self.version() != expected:
            raise RuntimeError("another version was published meanwhile")
        self.pointers.point(made, seen)
        return made

    def restore(self, version: str) -> None:
        """Make an older version the current one again; nothing is copied."""
        if version not in {self.pointers.held(n) for n, full in self.pointers.taken() if full}:
            raise ValueError(f"no such version: {version}")
        self.pointers.point(version)

    def clear(self, schemas: dict[str, DataFrame]) -> str:
        """Publish empty tables of the same schemas."""
        return self.publish({name: rows.limit(0) for name, rows in schemas.items()})
