"""Parquet sinks for the upsert / refresh operators.

Without a table format that supports MERGE, a rewrite replaces whole
partitions: the new rows of the touched partitions are first written to a
staging folder under the shared ``spark.checkpoint.dir`` (cutting the lineage,
so the target is never read and overwritten by the same plan), then copied
over the target with dynamic partition overwrite: only the partitions
present in the new data are replaced. A commit over several partitions is not
atomic; a job that fails midway is repeated, which replaces them all again.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import one_per_key, upsert_performance
from ..session import checkpoint_dir
from .batches import EVERY, BatchTable
from .versions import VersionedTable


def staging_path(df: DataFrame, name: str) -> str:
    return f"{checkpoint_dir(df.sparkSession).rstrip('/')}/staging/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table's folder is there, by Spark's own file system; other failures are raised."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def replace_partitions(df: DataFrame, target: str, partition_cols: list[str]) -> int:
    """Overwrite the partitions of ``target`` that ``df`` holds rows for;
    returns the number of rows written."""
    spark = df.sparkSession
    stage = staging_path(df, "replace")
    df.write.mode("overwrite").partitionBy(*partition_cols).parquet(stage)
    staged = spark.read.parquet(stage)
    (staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).parquet(target))
    return staged.count()


def append_new(df: DataFrame, target: str, key: list[str], partition_cols: list[str] | None = None) -> int:
    """Insert-ignore into a parquet table: rows whose key is not in ``target``
    yet (of several with one key the least row) are staged and appended. Of a
    partitioned target only the partitions that the batch has rows for are
    read, so the partition columns must follow from the key."""
    spark = df.sparkSession
    rest = [c for c in df.columns if c not in key]
    new = df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(
        *[F.col(f"_r.{c}").alias(c) if c in rest else F.col(c) for c in df.columns]) if rest else df.distinct()
    if path_exists(spark, target):
        existing = spark.read.parquet(target)
        if partition_cols:
            existing = existing.join(F.broadcast(df.select(*partition_cols).distinct()), partition_cols, "left_semi")
        new = new.join(existing.select(*key), key, "left_anti")
    stage = staging_path(df, "append")
    new.write.mode("overwrite").parquet(stage)
    staged = spark.read.parquet(stage)
    w = staged.write.mode("append")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.parquet(target)
    return staged.count()


KEY_BUCKETS = 256


class KeyedTable:
    """A table with unique keys (S5–S8): rows are stored by ``buckets`` of their key's hash, so
    an insert reads the key columns of the buckets that its rows fall into, and no others. Batches
    are numbered by the caller; a repeated batch replaces itself, or changes nothing once merged."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = KEY_BUCKETS, every: int | None = EVERY):
        self.key, self.buckets = key, buckets
        self.table = BatchTable(spark, path, ("key_bucket",), every)

    def insert(self, batch: DataFrame, batch_id: int, order: list[str] | None = None) -> DataFrame:
        """Store the rows whose key is new, one of each (the first by ``order``), and return them."""
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        rows = one_per_key(batch, self.key, order).withColumn("key_bucket", bucket)
        touched = [r["key_bucket"] for r in rows.select("key_bucket").distinct().collect()]      # at most ``buckets``
        if not self.table.covered(batch_id):
            known = self.table.read(rows.schema, without=batch_id).where(F.col("key_bucket").isin(touched)).select("key_bucket", *self.key)
            self.table.write(rows.join(known, ["key_bucket", *self.key], "left_anti").select(*rows.columns), batch_id)
        return self.table.of_batch(rows.schema, batch_id).select(*batch.columns)

    def read(self, schema) -> DataFrame:
        """The stored rows with their ``batch``."""
        return self.table.read(schema)


def upsert_performance_days(table: VersionedTable, batch: DataFrame, entities: DataFrame, now: str, order: list[str] | None = None) -> None:
    """U2 into a table partitioned by ``stat_date``: only the batch's days are read and replaced, all at once."""
    days = [r["stat_date"] for r in batch.select("stat_date").distinct().collect()]              # as many as the report's days
    table.write(upsert_performance(table.read(days), batch, entities, now, order), days)


def write_segment_refresh(segment_rows: list[dict], conversions: DataFrame, events: DataFrame | None,
                          app: str, now: str, target: str) -> DataFrame:
    """G16 sink: rebuild the membership of the given segments in one job,
    replace their ``segment_id`` partitions, and return the bookkeeping rows
    ``(id, status, last_count, last_refreshed_at, last_refresh_ms, last_error)``.
    Segments that are not active are skipped; a definition that fails to
    compile keeps its old membership and reports the error. Each refreshed
    segment also writes one marker row with a NULL user, so a segment whose
    new membership is empty still replaces its partition (readers count and
    page non-NULL users only)."""
    from ..operators import segments as sg
    spark = conversions.sparkSession
    ok, book = [], []
    for s in segment_rows:
        if s.get("status", "active") != "active":
            book.append((int(s["id"]), "skipped", None, None, None, None))
            continue
        try:
            d = sg.validate(s["definition"])
            if events is None and sg.references_events(d):
                raise sg.DefinitionError("segment references app events but they are not available")
            ok.append(s)
        except (sg.DefinitionError, ValueError) as e:
            book.append((int(s["id"]), "error", None, None, None, str(e)[:1000]))
    started = time.perf_counter()
    refreshed = []
    if ok:
        members = sg.refresh_segments(ok, conversions, events, app, now)
        markers = spark.createDataFrame([(int(s["id"]),) for s in ok], "segment_id long").select(
            "segment_id", F.lit(None).cast(members.schema["user_id"].dataType).alias("user_id"),
            F.lit(now).cast("timestamp_ntz").alias("computed_at"))
        replace_partitions(members.unionByName(markers), target, ["segment_id"])
        counts = {r.segment_id: r.n for r in spark.read.parquet(target)
                  .where(F.col("segment_id").isin(*[int(s["id"]) for s in ok]))
                  .groupBy("segment_id").agg(F.count("user_id").alias("n")).collect()}   # one row per segment
        ms = int((time.perf_counter() - started) * 1000)
        refreshed = [(int(s["id"]), "refreshed", int(counts.get(int(s["id"]), 0)), now, ms, None) for s in ok]
    return (spark.createDataFrame(refreshed + book, "id long, status string, last_count int, last_refreshed_at string, "
                                                    "last_refresh_ms int, last_error string")
            .withColumn("last_refreshed_at", F.col("last_refreshed_at").cast("timestamp_ntz")))
