"""Structured Streaming forms of the ingest operators.

The reference receives small HTTP batches and handles late data by clamping
and unbounded dedup keys; here the same rules run as streaming queries. Tables are
:class:`~touchline.sources.batches.BatchTable` folders: a retried micro-batch replaces its
own attempt, and parts are merged as they gather.

* T1 ``start_event_ingest`` — file source with an explicit schema → V4 validation →
  clamp ``occurred_at`` into ``[received_at − 30 d, received_at + 1 h]``
  (against the receive time, not the wall clock, so replays are
  deterministic) → the first copy per ``event_id`` by keyed state (``keyed.py``) →
  parquet partitioned by ``app, event_month``. Nothing is dropped for being late,
  and nothing stored is read.
* T2 ``keyed.start_keyed`` — insert-ignore of any stream on any key.
* T3 ``edge_rows`` + ``start_keyed`` — new identity edges;
  ``touch_backfill_batch`` — ``foreachBatch`` filling the users of anonymous touches,
  reading the buckets of the sessions in the micro-batch.
* T4 ``health_batch`` — ``foreachBatch`` writing each micro-batch's per-stream
  counts by minute, merged into one row a minute (a day, once out of every window);
  24 h / 7 d figures are sums over them (``rollup_health``), so a row counts however
  late it comes.
* T5 ``attribution_batch`` — ``foreachBatch`` over a stream of touches and conversions:
  stores both, and attributes again the conversions that are new or that a new touch may
  win, so the results are the batch operator's for any order of arrival.

Checkpoints and staging live under the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ingest as ig
from ..operators.attribution import resolve_attribution
from ..operators.identity import backfill_touch_users
from ..session import checkpoint_dir
from ..sources.batches import EVERY, BatchTable
from .keyed import start_keyed

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("app", T.StringType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("occurred_at", T.TimestampNTZType()),
    T.StructField("received_at", T.TimestampNTZType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("platform", T.StringType()),
    T.StructField("app_version", T.StringType()),
    T.StructField("props", T.StringType()),
])

# keep microseconds through the JSON files (the default format stops at ms)
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def clamp_to_receive(df: DataFrame) -> DataFrame:
    lo = F.col("received_at") - F.make_dt_interval(days=F.lit(ig.EVENT_MAX_AGE_DAYS))
    hi = F.col("received_at") + F.make_dt_interval(hours=F.lit(ig.EVENT_MAX_SKEW_HOURS))
    return df.withColumn("occurred_at", F.least(F.greatest(F.col("occurred_at"), lo), hi))


def valid_events(rows: DataFrame, zone: str = "Asia/Kolkata") -> DataFrame:
    """T1 transformation: valid, clamped events with ``event_month``."""
    valid = ig.validate_events(rows).where(F.size("reasons") == 0).drop("reasons")
    return clamp_to_receive(valid).withColumn("event_month", ig.assign_event_month(F.col("occurred_at"), zone))


def start_event_ingest(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
                       available_now: bool = True, max_files_per_trigger: int | None = None, zone: str = "Asia/Kolkata",
                       every: int | None = EVERY):
    """JSON files in ``source_dir`` → the table ``sink_dir`` (``stored_events``), each valid event once."""
    reader = spark.readStream.schema(EVENT_SCHEMA).option("timestampNTZFormat", TS_FORMAT)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = valid_events(reader.json(source_dir), zone)
    return start_keyed(rows, ["event_id"], sink_dir, checkpoint, ("app", "event_month"), every, available_now=available_now)


def stored_events(spark: SparkSession, sink_dir: str) -> DataFrame:
    """T1 read side."""
    schema = T.StructType([*EVENT_SCHEMA.fields, T.StructField("event_month", T.StringType())])
    return BatchTable(spark, sink_dir).read(schema).drop("batch")


def edge_rows(rows: DataFrame) -> DataFrame:
    """The ``(app, session_id, user_id)`` that rows of touches or conversions reveal."""
    return rows.where(F.col("session_id").isNotNull() & (F.col("session_id") != "") & F.col("user_id").isNotNull()).withColumn(
        "user_id", F.col("user_id").cast("bigint"))


SESSION_BUCKETS = 64


def touch_backfill_batch(touches_dir: str, fills_dir: str, buckets: int = SESSION_BUCKETS, every: int | None = EVERY):
    """A ``foreachBatch`` function storing touches and the users of the
    anonymous ones (U4): for the sessions that the batch has rows of, every
    stored anonymous touch is looked up again among all their revealing ones,
    so the result is U4's whatever order the files come in. Touches are stored by
    ``buckets`` of their sessions, and only the batch's buckets are read."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark, columns = batch.sparkSession, batch.columns
        bucket = F.pmod(F.xxhash64("app", "session_id"), F.lit(buckets)).cast("int")
        batch = batch.withColumn("bucket", bucket)
        table = BatchTable(spark, touches_dir, ("bucket",), every)
        table.write(batch, batch_id)
        sessions = batch.where(F.col("session_id").isNotNull()).select("app", "session_id", "bucket").distinct()
        known = [r["bucket"] for r in sessions.select("bucket").distinct().collect()]            # at most ``buckets``
        stored = table.read(batch.schema).where(F.col("bucket").isin(known))
        rows = stored.join(sessions.drop("bucket"), ["app", "session_id"], "left_semi").select(*columns)
        anonymous = rows.where(F.col("user_id").isNull()).select("id")
        fills = backfill_touch_users(rows).where(F.col("user_id").isNotNull()).select("id", "user_id").join(anonymous, "id", "left_semi")
        BatchTable(spark, fills_dir, every=every).write(fills, batch_id)
    return run


def backfilled_touches(spark: SparkSession, touches_dir: str, fills_dir: str, schema: T.StructType) -> DataFrame:
    """T3 read side: the stored touches (of ``schema``) with the latest fill of each anonymous one."""
    fills = BatchTable(spark, fills_dir).read(T.StructType([schema["id"], schema["user_id"]]))
    latest = fills.groupBy("id").agg(F.max_by("user_id", "batch").alias("_fill"))
    touches = BatchTable(spark, touches_dir).read(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())]))
    touches = touches.drop("batch", "bucket").join(latest, "id", "left")
    return touches.withColumn("user_id", F.coalesce("user_id", "_fill")).drop("_fill")


def attribution_rows(touches: DataFrame, conversions: DataFrame) -> DataFrame:
    """T5: one stream of ``touch`` and ``conversion`` structs, one of them set."""
    of = lambda df: F.struct(*df.columns)
    t = touches.select(of(touches).alias("touch"))
    c = conversions.select(of(conversions).alias("conversion"))
    kind = lambda df, name: df.schema[name].dataType
    return t.withColumn("conversion", F.lit(None).cast(kind(c, "conversion"))).unionByName(
        c.withColumn("touch", F.lit(None).cast(kind(t, "touch"))))


def _days(days: Iterable[dt.date], before: int = 0, after: int = 0) -> list[dt.date]:
    return sorted({d + dt.timedelta(days=k) for d in days for k in range(-before, after + 1)})


def _days_of(df: DataFrame) -> list[dt.date]:
    """The distinct days of a frame: as many as its time span has."""
    return [r["day"] for r in df.select("day").distinct().collect()]


def attribution_batch(store: str, entities: DataFrame | Callable[[SparkSession], DataFrame], app: str, lookback_days: int = 7,
                      every: int | None = EVERY):
    """T5: a ``foreachBatch`` function over ``attribution_rows``. Touches and conversions are stored by day
    under ``store``. Attributed are the batch's conversions, and of the stored ones those that
    share a user or session with one of the batch's touches and lie in its lookback; against all
    touches stored by then, of the days in question. ``attributed`` reads the latest results.
    A function for ``entities`` is asked anew in each batch."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept, new = {}, {}
        for kind in ("touch", "conversion"):
            new[kind] = batch.where(F.col(kind).isNotNull()).select(f"{kind}.*").withColumn("day", F.to_date("occurred_at"))
            table = BatchTable(spark, f"{store}/{kind}", ("day",), every)
            table.write(new[kind], batch_id)
            kept[kind] = table.read(new[kind].schema).drop("batch")
        reached = kept["conversion"].where(F.col("day").isin(_days(_days_of(new["touch"]), after=lookback_days)))
        asked = new["conversion"]
        for key in ("user_id", "session_id"):
            keys = new["touch"].where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).select("app", key).distinct()
            asked = asked.unionByName(reached.join(keys, ["app", key], "left_semi").select(*asked.columns))
        asked = asked.dropDuplicates(["app", "order_id"])
        touches = kept["touch"].where(F.col("day").isin(_days(_days_of(asked), before=lookback_days)))
        found = resolve_attribution(asked.drop("day"), touches.drop("day"), entities(spark) if callable(entities) else entities,
                                    app, lookback_days)
        BatchTable(spark, f"{store}/result", every=every).write(found, batch_id)
    return run


def attributed(spark: SparkSession, store: str, conversions: T.StructType) -> DataFrame:
    """T5 read side: the latest result of every conversion (of schema ``conversions``)."""
    schema = T.StructType([*conversions.fields, *T.StructType.fromDDL(
        "attributed_entity_id long, attributed_channel string, attribution_model string, attribution_outcome string, "
        "attributed_touch_id long, resolved_at timestamp_ntz").fields])
    found = BatchTable(spark, f"{store}/result").read(schema)
    latest = found.groupBy("app", "order_id").agg(F.max_by(F.struct(*[c for c in schema.names if c not in ("app", "order_id")]), "batch").alias("r"))
    return latest.select("app", "order_id", "r.*").select(*schema.names)


HEALTH_SCHEMA = "source string, event_name string, minute timestamp_ntz, grain string, n long, last_seen timestamp_ntz"
HEALTH_DAYS = 8              # days before the newest row whose minutes are kept apart


def _merged_health(counts: DataFrame) -> DataFrame:
    """Counts of one stream and minute as one row; of a day, where no window can end in it any more."""
    old = F.col("minute") < F.date_trunc("day", F.col("newest")).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(HEALTH_DAYS))
    counts = counts.crossJoin(F.broadcast(counts.agg(F.max("minute").alias("newest"))))           # one row
    counts = counts.withColumn("grain", F.when(old, "day").otherwise(F.col("grain"))).withColumn(
        "minute", F.when(old, F.date_trunc("day", "minute").cast("timestamp_ntz")).otherwise(F.col("minute")))
    return counts.groupBy("source", "event_name", "minute", "grain").agg(F.sum("n").alias("n"), F.max("last_seen").alias("last_seen")).select(
        *T.StructType.fromDDL(HEALTH_SCHEMA).names)


def health_batch(counts_dir: str, every: int | None = EVERY):
    """T4: a ``foreachBatch`` function storing the counts by minute per
    ``(source, event_name)`` of a micro-batch of ``(source, event_name, ts)`` rows."""
    def run(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("source", "event_name", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(
            F.lit("minute").alias("grain"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_seen"))
        BatchTable(batch.sparkSession, counts_dir, every=every, combine=_merged_health).write(counts, batch_id)
    return run


def health_counts(spark: SparkSession, counts_dir: str) -> DataFrame:
    """T4: the stored counts. A merge leaves a row per stream and minute of the last days, so
    they are few, and stand in a bounded number of files."""
    return BatchTable(spark, counts_dir).read(HEALTH_SCHEMA).drop("batch")


def rollup_health(counts: DataFrame, now: str) -> DataFrame:
    """T4 read side: count_24h / count_7d / last_seen from the stored counts; ``now`` is a whole
    minute, so no count lies across an edge. It is an error where ``now`` is so long past that
    its windows reach into counts merged by day."""
    at = dt.datetime.fromisoformat(now)
    if at.second or at.microsecond:
        raise ValueError(f"now must be a whole minute: {now}")
    n = F.lit(now).cast("timestamp_ntz")
    start = F.col("minute")
    week = n - F.make_dt_interval(days=F.lit(7))
    across = (F.col("grain") == "day") & (start + F.make_dt_interval(days=F.lit(1)) > week)
    number = F.when(across, F.raise_error(F.lit(f"the counts a week before {now} are merged by day"))).otherwise(F.col("n"))
    return (counts.groupBy("source", "event_name")
            .agg(F.sum(F.when(start >= n - F.make_dt_interval(hours=F.lit(24)), number).otherwise(0)).alias("count_24h"),
                 F.sum(F.when((start >= week) | across, number).otherwise(0)).alias("count_7d"),
                 F.max("last_seen").alias("last_seen")))
