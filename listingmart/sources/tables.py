"""Warehouse tables as versioned Parquet folders.

A table is a folder of versions and numbered pointer files; the last names the current version. A replacement writes a
whole new version and then the pointer of the next number, which only one writer can create, so readers see the old or
the new rows, never a mix, no update is lost, and no job reads what it overwrites. All file operations go through Hadoop's file system of the path.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConcurrentReplacementError(RuntimeError):
    """Another writer replaced the table first."""


class Warehouse:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self, name: str) -> list[tuple[str, str]]:
        """(pointer, version) by number; a pointer whose writer has not closed it yet names no version."""
        folder, fs = self._path(name)
        if not fs.exists(folder):
            return []
        found = []
        for pointer in sorted(f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName().startswith("current-")):
            stream = fs.open(self._path(name, pointer)[0])
            try:
                found.append((pointer, bytes(stream.readAllBytes()).decode()))
            finally:
                stream.close()
        return found

    def version(self, name: str) -> str | None:
        """The pointer of the highest number names the current version."""
        named = [version for _, version in self._pointers(name) if version]
        return named[-1] if named else None

    def exists(self, name: str) -> bool:
        return self.version(name) is not None

    def read(self, name: str) -> DataFrame:
        if (version := self.version(name)) is None:
            raise ValueError(f"no table {name}")
        return self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def replace(self, df: DataFrame, name: str, schema: T.StructType | None = None, partition_by: list[str] | None = None) -> DataFrame:
        """Write df (cast to the schema, if given) as the table's new version. The version before stays for its readers;
        older ones go. Of two replacements at once one fails."""
        if schema is not None:
            df = df.select(*(F.col(f.name).cast(f.dataType) for f in schema))
        version, before = f"v{uuid.uuid4().hex}", self._pointers(name)
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.root}/{name}/{version}")
        number = int(before[-1][0].split("-")[1]) + 1 if before else 1
        pointer, fs = self._path(name, f"current-{number:012d}")
        try:
            out = fs.create(pointer, False)
        except Exception as e:
            fs.delete(self._path(name, version)[0], True)
            raise ConcurrentReplacementError(f"{name} was replaced meanwhile") from e
        out.write(bytearray(version.encode()))
        out.close()
        for old, gone in before[:-1]:
            fs.delete(self._path(name, old)[0], False)
            if gone:
                fs.delete(self._path(name, gone)[0], True)
        return self.read(name)

    def append(self, df: DataFrame, name: str) -> None:
        """Add rows to a table that is only ever appended to."""
        if (version := self.version(name)) is None:
            self.replace(df, name)
        else:
            df.write.mode("append").parquet(f"{self.root}/{name}/{version}")

    def count(self, name: str) -> int:
        return self.read(name).count()


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV with header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
