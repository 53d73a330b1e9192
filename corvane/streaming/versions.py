"""Tables in versions: parts by a hash of the key, of which a change rewrites those it touches, and a list of parts a version.

A version is there once its list is: the list is written beside and then renamed, so that a reader sees one version or
the other. A version that is written again after a failure replaces the same parts. Readers name a version, or take the
latest; ``clean`` removes parts that no kept version lists.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """folder: where it lies; schema: its columns; key: the column that rows are dealt by; parts: into how many."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, parts: int = 16) -> None:
        self.spark, self.folder, self.schema, self.key, self.parts = spark, folder.rstrip("/"), schema, key, parts
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *at: path("/".join([self.folder, *at]))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path("lists")
        found = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in found if n.endswith(".json"))

    def before(self, version: int) -> int | None:
        """The latest version before this one."""
        return max((v for v in self.versions() if v < version), default=None)

    def listed(self, version: int | None) -> dict[int, int]:
        """The version in which each part was last written."""
        if version is None:
            return {}
        stream = self._fs.open(self._path("lists", f"{version}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(k): v for k, v in json.loads(text).items()}

    def part_of(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def read(self, version: int | None, parts: Iterable[int] | None = None) -> DataFrame:
        """The table, or some of its parts, in a version; empty before the first."""
        listed = self.listed(version)
        wanted = listed if parts is None else [p for p in parts if p in listed]
        paths = [f"{self.folder}/data/v{listed[p]}/part={p}" for p in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def latest(self) -> DataFrame:
        versions = self.versions()
        return self.read(versions[-1] if versions else None)

    def write(self, rows: DataFrame, version: int, touched: Iterable[int]) -> None:
        """Version ``version``: ``rows`` are all rows of the touched parts; other parts stay what they were before it."""
        listed, touched = self.listed(self.before(version)), sorted(touched)
        data = f"{self.folder}/data/v{version}"
        self._fs.delete(self._path("data", f"v{version}"), True)
        if touched:
            rows.withColumn("part", self.part_of(self.key)).repartition("part").write.partitionBy("part").parquet(data)
        for p in touched:
            if self._fs.exists(self._path("data", f"v{version}", f"part={p}")):
                listed[p] = version
            else:
                listed.pop(p, None)  # it has no rows left
        beside = self._path("lists", f".{version}.writing")
        self._fs.mkdirs(self._path("lists"))
        out = self._fs.create(beside, True)
        out.write(bytearray(json.dumps(listed).encode()))
        out.close()
        final = self._path("lists", f"{version}.json")
        if self._fs.exists(final):  # a version written again: the same parts
            self._fs.delete(final, False)
        if not self._fs.rename(beside, final):
            raise OSError(f"{final.toString()} couldn't be put in place")

    def clean(self, keep: int = 2) -> None:
        """Remove what only versions before the last ``keep`` use; a reader may hold one of those kept."""
        versions = self.versions()
        kept = versions[-keep:]
        used = {(v, p) for k in kept for p, v in self.listed(k).items()}
        for version in versions[: len(versions) - len(kept)]:
            self._fs.delete(self._path("lists", f"{version}.json"), False)
        folder = self._path("data")
        for old in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            number = int(old.getPath().getName().removeprefix("v"))
            if kept and number > kept[-1]:
                continue  # being written
            left = 0
            for part in self._fs.listStatus(old.getPath()):
                name = part.getPath().getName()
                if name.startswith("part=") and (number, int(name.removeprefix("part="))) not in used:
                    self._fs.delete(part.getPath(), True)
                else:
                    left += name.startswith("part=")
            if not left:
                self._fs.delete(old.getPath(), True)
