"""Tables made of one folder per micro-batch, merged as they grow.

A micro-batch writes its own ``batch_id=<n>`` folder with overwrite, so a retry
replaces its own attempt. Where ``every`` folders of one level have gathered, they are
rewritten as one of the next level, ``run=<level>_<first>_<last>``, and the marker
``run=<level>_<first>_<last>.done`` is created: from the marker on readers take the run
instead of what it covers, before it they don't see it, so a merge that fails midway
changes nothing. What a run covers is removed by the next merge, so that readers that
have begun can end. A batch that a run covers is never written again: a retry of it finds
its rows stored. A level has at most ``every`` live folders, and a row is rewritten once
a level.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVERY = 16


def file_at(spark: SparkSession, path: str):
    """Spark's file system for a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none where it is missing; other failures are raised."""
    fs, p = file_at(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_at(spark, path)
    fs.delete(p, True)


class Part(NamedTuple):
    level: int
    first: int
    last: int

    @property
    def name(self) -> str:
        return f"run={self.level}_{self.first}_{self.last}" if self.level else f"batch_id={self.first}"

    def covers(self, other: Part) -> bool:
        return self.level > other.level and self.first <= other.first and other.last <= self.last


class BatchTable:
    """A table in the folder ``path``. ``partition_by``: columns of folders inside each part;
    ``combine`` reduces rows that are merged, where they stand for others, like partial counts."""

    def __init__(self, spark: SparkSession, path: str, partition_by: tuple[str, ...] = (), every: int | None = EVERY,
                 combine: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.partition_by, self.every, self.combine = spark, path.rstrip("/"), partition_by, every, combine

    def _runs(self, found: list[str]) -> list[Part]:
        return [Part(*map(int, m.groups())) for m in (re.fullmatch(r"run=(\d+)_(-?\d+)_(-?\d+)\.done", n) for n in found) if m]

    def _every(self) -> list[Part]:
        found = names(self.spark, self.path)
        return self._runs(found) + [Part(0, int(m[1]), int(m[1])) for m in (re.fullmatch(r"batch_id=(-?\d+)", n) for n in found) if m]

    def parts(self) -> list[Part]:
        """What makes up the table now, in the order of the batches."""
        every = self._every()
        return sorted((p for p in every if not any(q.covers(p) for q in every)), key=lambda p: p.first)

    def covered(self, batch_id: int) -> bool:
        """Whether a batch is merged already."""
        return any(r.first <= batch_id <= r.last for r in self._runs(names(self.spark, self.path)))

    def write(self, df: DataFrame, batch_id: int) -> None:
        """Store a batch, in place of an earlier attempt at it, and merge what has gathered."""
        if self.covered(batch_id):
            return
        self._write(df.withColumn("batch", F.lit(batch_id).cast("long")), Part(0, batch_id, batch_id))
        level = 0
        while self.every:
            parts = [p for p in self.parts() if p.level == level and p.first != batch_id]   # the batch itself can be retried
            if len(parts) < self.every:
                break
            self.merge(parts, df.schema)
            level += 1

    def _write(self, df: DataFrame, part: Part) -> None:
        w = df.write.mode("overwrite")
        (w.partitionBy(*self.partition_by) if self.partition_by else w).parquet(f"{self.path}/{part.name}")

    def _read(self, parts: list[Part], schema: T.StructType | str) -> DataFrame:
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        schema = T.StructType([f for f in schema.fields if f.name != "batch"] + [T.StructField("batch", T.LongType())])
        out = None
        for part in parts:                                 # folders within a part are columns, so each is read by itself
            df = self.spark.read.schema(schema).parquet(f"{self.path}/{part.name}").select(*schema.names)
            out = df if out is None else out.unionByName(df)
        return self.spark.createDataFrame([], schema) if out is None else out

    def read(self, schema: T.StructType | str, without: int | None = None) -> DataFrame:
        """The rows, with their ``batch`` (of combined rows the last one's), but those of the batch ``without``."""
        return self._read([p for p in self.parts() if without is None or (p.first, p.last) != (without, without)], schema)

    def of_batch(self, schema: T.StructType | str, batch_id: int) -> DataFrame:
        """The rows of one batch, from the part that holds it."""
        return self._read([p for p in self.parts() if p.first <= batch_id <= p.last], schema).where(F.col("batch") == batch_id)

    def merge(self, parts: list[Part], schema: T.StructType) -> None:
        """Rewrite consecutive parts as one of the next level, and remove what earlier merges have covered."""
        every = self._every()
        for part in [p for p in every if any(q.covers(p) for q in every)]:
            if part.level:
                remove(self.spark, f"{self.path}/{part.name}.done")
            remove(self.spark, f"{self.path}/{part.name}")
        to = Part(max(p.level for p in parts) + 1, min(p.first for p in parts), max(p.last for p in parts))
        rows = self._read(parts, schema)
        if self.combine:
            rows = self.combine(rows.drop("batch")).withColumn("batch", F.lit(to.last).cast("long"))
        self._write(rows, to)
        fs, p = file_at(self.spark, f"{self.path}/{to.name}.done")
        fs.create(p, True).close()                         # the commit
