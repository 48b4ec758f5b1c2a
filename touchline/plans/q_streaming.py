"""Registered streaming queries (T1–T5): each stages derived rows as files
under the shared checkpoint folder, runs the streaming query with an
``availableNow`` trigger, and returns the sink read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitor as mo
from ..sources.batches import BatchTable
from ..streaming import ingest as st
from ..streaming.keyed import start_keyed
from .params import APP, LOOKBACK_DAYS, NOW
from .q_attribution import RESOLVE_SQL_CTES
from .q_ingest import EVENT_RULES, UUID_EVENTS_SQL, _reasons_sql, _uuid_events
from .registry import BODIES, register


def run_event_files(spark, frame) -> str:
    """Stage ``frame`` as JSON files, about a seventh of it a second time (a
    redelivery), run T1 over them and return the sink."""
    base = st.scratch(spark, "event-stream")
    _stage_json(frame, f"{base}/in/a")
    _stage_json(frame.where(F.crc32(F.col("event_id")) % 7 == 0), f"{base}/in/b")
    st.start_event_ingest(spark, f"{base}/in/*", f"{base}/out", f"{base}/ckpt").awaitTermination()
    return f"{base}/out"


@register("stream_ingest_events", f"""WITH {UUID_EVENTS_SQL},
 v AS (SELECT * FROM ue WHERE {_reasons_sql(EVENT_RULES)} = '')
SELECT DISTINCT event_id, app, occurred_at, strftime(occurred_at + INTERVAL 330 MINUTE, '%Y_%m') AS event_month FROM v""",
          ("app_event",))
def stream_ingest_events(t):
    """UUID-keyed events (some invalid) written as JSON files plus one
    redelivered file, ingested by the streaming job; the sink holds each valid
    event once."""
    frame = _uuid_events(t).drop("n").withColumn("received_at", F.col("occurred_at"))
    sink = run_event_files(t.spark, frame)
    return st.stored_events(t.spark, sink).select("event_id", "app", "occurred_at", "event_month")


@register("stream_health", f"""
WITH rows AS (
  SELECT 'app' AS source, event_name, occurred_at AS ts FROM app_event WHERE app = '{APP}'
  UNION ALL SELECT 'click', NULL, occurred_at FROM attribution_touch WHERE app = '{APP}' AND touch_type = 'first_party_click'
  UNION ALL SELECT 'touch', NULL, occurred_at FROM attribution_touch WHERE app = '{APP}' AND touch_type <> 'first_party_click'
  UNION ALL SELECT 'lead', NULL, occurred_at FROM lead_event WHERE app = '{APP}'
  UNION ALL SELECT 'conversion', NULL, occurred_at FROM conversion WHERE app = '{APP}')
SELECT source, event_name, count(*) FILTER (WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) AS count_24h,
  count(*) FILTER (WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS count_7d, max(ts) AS last_seen
FROM rows GROUP BY 1, 2""", ("app_event", "attribution_touch", "lead_event", "conversion"))
def stream_health(t):
    """T4: per-stream counts by minute written per micro-batch, rolled up to 24 h / 7 d."""
    return st.rollup_health(_run_health(t), NOW)


def _run_health(t):
    """The five streams' rows through T4, four files a micro-batch, merged every other micro-batch."""
    spark = t.spark
    rows = mo.stream_rows(t.app_event, t.attribution_touch, t.lead_event, t.conversion, APP)
    base = st.scratch(spark, "health-stream")
    rows.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
    q = (stream.writeStream.foreachBatch(st.health_batch(f"{base}/out", every=2))
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return st.health_counts(spark, f"{base}/out")


@register("streams_overview_counters", BODIES["streams_overview"], ("app_event", "attribution_touch", "lead_event", "conversion", "event_registry"))
def streams_overview_counters(t):
    """N1 from the counters of T4: no stored event or touch is read."""
    return mo.overview_of(st.rollup_health(_run_health(t), NOW), t.event_registry, APP, NOW)


@register("stream_insert_conversions", """SELECT app, order_id, CAST(value_inr AS DOUBLE) AS value FROM conversion""",
          ("conversion",))
def stream_insert_conversions(t):
    """Conversions arrive as JSON files, half of them delivered twice,
    two files per micro-batch; insert-ignore on ``(app, order_id)`` by
    keyed state keeps each order once."""
    spark = t.spark
    base = st.scratch(spark, "conv-stream")
    conv = t.conversion
    conv.write.option("timestampNTZFormat", st.TS_FORMAT).json(f"{base}/in/a")
    conv.where(F.col("id") % 2 == 0).write.option("timestampNTZFormat", st.TS_FORMAT).json(f"{base}/in/b")
    stream = (spark.readStream.schema(conv.schema).option("timestampNTZFormat", st.TS_FORMAT)
              .option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").json(f"{base}/in"))
    start_keyed(stream, ["app", "order_id"], f"{base}/target", f"{base}/ckpt", every=3).awaitTermination()
    return BatchTable(spark, f"{base}/target").read(conv.schema).select("app", "order_id", F.col("value_inr").cast("double").alias("value"))


def _stage_json(df, path):
    df.write.option("timestampNTZFormat", st.TS_FORMAT).json(path)


@register("stream_attribution", f"""WITH {RESOLVE_SQL_CTES}
SELECT app, order_id, attributed_entity_id, attributed_channel, attribution_outcome FROM resolved""",
          ("conversion", "attribution_touch", "ad_entity"))
def stream_attribution(t):
    """T5: conversions and touches arrive as files of rows in no order of time, so touches
    come before and after the conversions that they win; two files of each a micro-batch."""
    spark = t.spark
    base = st.scratch(spark, "attr-stream")
    conv, touches = t.conversion.where(F.col("app") == APP), t.attribution_touch
    streams = []
    for name, rows in (("touch", touches), ("conversion", conv)):
        rows.repartition(4, F.xxhash64("id")).write.parquet(f"{base}/{name}")
        streams.append(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/{name}"))
    run = st.attribution_batch(f"{base}/store", t.ad_entity, APP, LOOKBACK_DAYS)
    q = (st.attribution_rows(*streams).writeStream.foreachBatch(run).option("checkpointLocation", f"{base}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return st.attributed(spark, f"{base}/store", conv.schema).select(
        "app", "order_id", "attributed_entity_id", "attributed_channel", "attribution_outcome")


@register("stream_identity_edges", """
SELECT DISTINCT app, session_id, user_id FROM (
  SELECT app, session_id, user_id FROM attribution_touch UNION ALL SELECT app, session_id, user_id FROM conversion) s
WHERE session_id IS NOT NULL AND session_id <> '' AND user_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM identity_link l WHERE l.app = s.app AND l.session_id = s.session_id AND l.user_id = s.user_id)""",
          ("attribution_touch", "conversion", "identity_link"))
def stream_identity_edges(t):
    """Touches and conversions stream in; stored are the identity edges not known
    before. The existing edges go through the stream first, by a file of their own."""
    spark = t.spark
    base = st.scratch(spark, "edge-stream")
    rows = (t.attribution_touch.select("app", "session_id", "user_id")
            .unionByName(t.conversion.select("app", "session_id", "user_id")))
    rows = rows.select("app", "session_id", F.col("user_id").cast("bigint").alias("user_id"), F.lit(False).alias("known"))
    known = t.identity_link.select("app", "session_id", F.col("user_id").cast("bigint").alias("user_id"), F.lit(True).alias("known"))
    for name, df in (("known", known), ("rows", rows)):
        df.write.parquet(f"{base}/in/{name}")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).option("recursiveFileLookup", "true").parquet(f"{base}/in")
        start_keyed(st.edge_rows(stream), ["app", "session_id", "user_id"], f"{base}/edges", f"{base}/ckpt", where="NOT known").awaitTermination()
    return BatchTable(spark, f"{base}/edges").read(rows.schema).select("app", "session_id", "user_id")


@register("stream_touch_backfill", BODIES["backfill_touch_users"], ("attribution_touch",))
def stream_touch_backfill(t):
    """Touches stream in, two files a micro-batch; the sessions of each batch are filled again."""
    spark = t.spark
    base = st.scratch(spark, "fill-stream")
    t.attribution_touch.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(t.attribution_touch.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    q = (stream.writeStream.foreachBatch(st.touch_backfill_batch(f"{base}/touches", f"{base}/fills"))
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return st.backfilled_touches(spark, f"{base}/touches", f"{base}/fills", t.attribution_touch.schema).select("id", "user_id")
