"""Stream-health monitor.

N1 projects the five monitored streams (product events by name; first-party
clicks, other touches, leads and conversions as whole streams) into one
``(source, event_name, ts)`` frame, aggregates once, and full-outer-joins the
registry. A registry row with an empty event name is the whole stream
(N3): it folds the per-name rows of its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Monitored sources, cadences and the stale factor (DECISION:
# a stream is stale once its age exceeds twice its cadence).
MONITOR_SOURCES = ["app", "click", "lead", "conversion", "touch"]
CADENCE_HOURS = {"hourly": 1, "daily": 24, "weekly": 24 * 7}
STALE_FACTOR = 2


def stream_rows(events: DataFrame, touches: DataFrame, leads: DataFrame, conversions: DataFrame,
                app: str) -> DataFrame:
    """The five sources as ``(source, event_name, ts)``."""
    def proj(df, source, name_col=None):
        name = F.col(name_col) if name_col else F.lit(None).cast("string")
        return df.where(F.col("app") == app).select(F.lit(source).alias("source"), name.alias("event_name"),
                                                    F.col("occurred_at").alias("ts"))
    fpc = F.col("touch_type") == "first_party_click"
    return (proj(events, "app", "event_name")
            .unionByName(proj(touches.where(fpc), "click"))
            .unionByName(proj(touches.where(~fpc | F.col("touch_type").isNull()), "touch"))
            .unionByName(proj(leads, "lead"))
            .unionByName(proj(conversions, "conversion")))


def health(last_seen, registered, is_active, frequency, now) -> F.Column:
    """N2 grading: muted / unregistered / ok (no cadence) / stale / ok."""
    age_limit = F.lit(None).cast("timestamp_ntz")
    for freq, hours in CADENCE_HOURS.items():
        age_limit = F.when(frequency == freq, now - F.make_dt_interval(hours=F.lit(hours * STALE_FACTOR))) \
            .otherwise(age_limit)
    return (F.when(registered & ~is_active, F.lit("muted"))
            .when(~registered, F.lit("unregistered"))
            .when(frequency == "none", F.lit("ok"))
            .when(last_seen.isNull() | (last_seen < age_limit), F.lit("stale"))
            .otherwise(F.lit("ok")))


def streams_overview(events: DataFrame, touches: DataFrame, leads: DataFrame, conversions: DataFrame,
                     registry: DataFrame, app: str, now: str) -> DataFrame:
    """Per stream count_24h, count_7d, last_seen, registry info, health.

    ``last_seen`` needs the whole history, in one aggregate with map-side
    partial results; where that is too long to read per run, ``overview_of`` gives
    the same figures from the streaming counters (T4)."""
    n = F.lit(now).cast("timestamp_ntz")
    rows = stream_rows(events, touches, leads, conversions, app)
    return overview_of(rows.groupBy("source", "event_name").agg(
        F.count_if(F.col("ts") >= n - F.make_dt_interval(hours=F.lit(24))).alias("count_24h"),
        F.count_if(F.col("ts") >= n - F.make_dt_interval(days=F.lit(7))).alias("count_7d"),
        F.max("ts").alias("last_seen")), registry, app, now)


def overview_of(per_name: DataFrame, registry: DataFrame, app: str, now: str) -> DataFrame:
    """N1 from the figures ``count_24h, count_7d, last_seen`` of each ``(source, event_name)``
    of the app: as T4 keeps them, or counted from the rows."""
    n = F.lit(now).cast("timestamp_ntz")
    per_name = per_name.select("source", "event_name", F.col("count_24h").alias("c24"), F.col("count_7d").alias("c7"), "last_seen")
    # Whole-stream fold of the per-name rows (second aggregate over the
    # small per-name result, not over the raw rows)
    folded = (per_name.where(F.col("event_name").isNotNull()).groupBy("source")
              .agg(F.sum("c24").alias("c24"), F.sum("c7").alias("c7"), F.max("last_seen").alias("last_seen"))
              .select("source", F.lit(None).cast("string").alias("event_name"), "c24", "c7", "last_seen",
                      F.lit(True).alias("_fold")))
    streams = per_name.withColumn("_fold", F.lit(False)).unionByName(folded)
    reg = (registry.where((F.col("app") == app) & F.col("source").isin(*MONITOR_SOURCES))
           .select(F.col("source").alias("r_source"), F.nullif(F.col("event_name"), F.lit("")).alias("r_name"),
                   "expected_frequency", "is_active", F.lit(True).alias("_reg")))
    j = streams.join(reg, (F.col("source") == F.col("r_source"))
                     & F.col("event_name").eqNullSafe(F.col("r_name")), "full")
    registered = F.coalesce(F.col("_reg"), F.lit(False))
    j = j.where(~F.coalesce(F.col("_fold"), F.lit(False)) | registered)   # a fold row needs its registry row
    last = F.col("last_seen")
    return j.select(
        F.coalesce("source", "r_source").alias("source"), F.coalesce("event_name", "r_name").alias("event_name"),
        F.coalesce("c24", F.lit(0)).cast("int").alias("count_24h"),
        F.coalesce("c7", F.lit(0)).cast("int").alias("count_7d"), last.alias("last_seen"),
        "expected_frequency", "is_active",
        health(last, registered, F.coalesce(F.col("is_active"), F.lit(True)), F.col("expected_frequency"), n)
        .alias("health"))


def _recent(df: DataFrame, n: int | None, *tiebreak: str) -> DataFrame:
    """The newest ``n`` rows, newest first; all of them for None."""
    out = df.orderBy(F.col("occurred_at").desc(), *[F.col(c).desc() for c in tiebreak])
    return out if n is None else out.limit(n)


def recent_app(events: DataFrame, app: str, n: int | None, event_name: str | None = None) -> DataFrame:
    """Newest product events (optionally of one name)."""
    e = events.where(F.col("app") == app)
    if event_name:
        e = e.where(F.col("event_name") == event_name)
    return _recent(e.select("event_id", "event_name", "occurred_at", "session_id", "user_id", "platform", "props"),
                   n, "event_id")


def recent_clicks(touches: DataFrame, app: str, n: int | None) -> DataFrame:
    """Newest first-party clicks; only link_id / is_bot / device from raw."""
    t = touches.where((F.col("app") == app) & (F.col("touch_type") == "first_party_click"))
    raw = F.col("raw") if "raw" in touches.columns else F.lit(None).cast("string")
    return _recent(t.select("id", "occurred_at", "session_id", "user_id",
                            F.get_json_object(raw, "$.link_id").alias("link_id"),
                            F.get_json_object(raw, "$.is_bot").alias("is_bot"),
                            F.get_json_object(raw, "$.device").alias("device")), n, "id")


def recent_leads(leads: DataFrame, app: str, n: int | None) -> DataFrame:
    """Newest leads with lead_ref and the uploaded flag."""
    return _recent(leads.where(F.col("app") == app).select(
        "id", "occurred_at", "lead_ref", F.col("capi_uploaded_at").isNotNull().alias("capi_uploaded")), n, "id")


def recent_conversions(conversions: DataFrame, app: str, n: int | None) -> DataFrame:
    """Newest conversions with order id and value."""
    return _recent(conversions.where(F.col("app") == app).select(
        "id", "occurred_at", "session_id", "user_id", "order_id", F.col("value_inr").cast("double").alias("value")),
        n, "id")


def recent_touches(touches: DataFrame, app: str, n: int | None) -> DataFrame:
    """Newest non-click touches; click ids only as presence flags."""
    t = touches.where((F.col("app") == app) & (F.col("touch_type") != "first_party_click"))
    return _recent(t.select("id", "occurred_at", "session_id", "user_id", "channel", "utm_source", "utm_campaign",
                            F.col("gclid").isNotNull().alias("has_gclid"),
                            F.col("fbclid").isNotNull().alias("has_fbclid"),
                            F.col("ctwa_clid").isNotNull().alias("has_ctwa_clid")), n, "id")
