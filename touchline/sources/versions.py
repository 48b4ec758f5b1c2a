"""Partitioned tables whose writes replace whole partitions and appear at once.

Each write puts its partitions under ``data/version=<n>`` and then renames a small list
into ``current/<n>``: a line for every partition of the table with the version that holds it.
Readers take the newest list, so a write that fails before its rename changes nothing, and
one that loses a race is an error. Only the partitions that a reader asks for are listed
and opened. What the last two lists don't name is removed by the next write.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .batches import file_at, names, remove


class VersionedTable:
    """A table in the folder ``path``, partitioned by one column of ``schema``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, partition: str):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def versions(self) -> list[int]:
        return sorted(int(n) for n in names(self.spark, f"{self.path}/current") if n.isdigit())

    def parts(self, version: int | None = None) -> dict[str, int]:
        """For each partition (its folder's name) the version that holds it."""
        version = max(self.versions(), default=None) if version is None else version
        if version is None:
            return {}
        rows = self.spark.read.text(f"{self.path}/current/{version}").collect()        # a line a partition
        return {k: int(v) for k, v in (r["value"].split("\t") for r in rows if r["value"])}

    def _folder(self, value) -> str:
        return f"{self.partition}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}"

    def read(self, values: Iterable | None = None) -> DataFrame:
        """The table, or the partitions of the given values."""
        held = self.parts()
        wanted = held if values is None else {k: held[k] for k in map(self._folder, values) if k in held}
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        schema = T.StructType([*self.schema.fields, T.StructField("version", T.LongType())])
        paths = [f"{self.path}/data/version={v}/{k}" for k, v in sorted(wanted.items())]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths).select(*self.schema.names)

    def write(self, df: DataFrame, values: Iterable) -> None:
        """Replace the partitions of the given values by the rows of ``df``, which has no others."""
        known = self.versions()
        version, held = max(known, default=-1) + 1, self.parts()
        self._clean(known)
        data = f"{self.path}/data/version={version}"
        df.select(*self.schema.names).write.mode("overwrite").partitionBy(self.partition).parquet(data)
        for k in map(self._folder, values):
            held.pop(k, None)
        held |= {n: version for n in names(self.spark, data) if n.startswith(f"{self.partition}=")}
        self._commit(version, "".join(f"{k}\t{v}\n" for k, v in sorted(held.items())))

    def _commit(self, version: int, text: str) -> None:
        fs, attempt = file_at(self.spark, f"{self.path}/attempts/{version}")
        out = fs.create(attempt, True)
        out.write(bytearray(text.encode()))
        out.close()
        _, to = file_at(self.spark, f"{self.path}/current/{version}")
        fs.mkdirs(to.getParent())
        if fs.exists(to) or not fs.rename(attempt, to):
            raise RuntimeError(f"another write of version {version} of {self.path} came first")

    def _clean(self, known: list[int]) -> None:
        used = {v for n in known[-2:] for v in self.parts(n).values()}
        for name in names(self.spark, f"{self.path}/data"):
            v = int(name.removeprefix("version="))
            if v not in used and known and v <= known[-1]:
                remove(self.spark, f"{self.path}/data/{name}")
        for n in known[:-2]:
            remove(self.spark, f"{self.path}/current/{n}")
