"""
They are timed by ``bench.py`` next to the optimised forms and used by the
tests as independent oracles; they are not registered queries."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import segments as sg
from ..operators.events import identified_events
from ..sources.bindings import DriverTables
from .params import APP, DAY_FROM, DAY_TO, LOOKBACK_DAYS, NOW
from .q_segments import SEG_DEFS, _due_ids


def last_touch_range_join(conversions: DataFrame, touches: DataFrame, app: str, lookback_days: int) -> DataFrame:
    """A1 as two range joins + ``row_number`` per conversion."""
    c = conversions.where(F.col("app") == app).alias("c")
    t = touches.where(F.col("app") == app).alias("t")

    def tier(key: str) -> DataFrame:
        cond = ((F.col(f"t.{key}") == F.col(f"c.{key}")) & (F.col("t.occurred_at") <= F.col("c.occurred_at"))
                & (F.col("t.occurred_at") >= F.col("c.occurred_at") - F.make_dt_interval(days=F.lit(lookback_days))))
        j = c.join(t, cond).select(F.col("c.id").alias("conv_id"), F.col("t.id").alias("touch_id"),
                                   F.col("t.occurred_at").alias("ts"), F.col("t.received_at").alias("rt"))
        w = Window.partitionBy("conv_id").orderBy(F.desc("ts"), F.desc("rt"), F.desc("touch_id"))
        return j.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("conv_id", F.col("touch_id").alias(key))

    u, s = tier("user_id"), tier("session_id")
    base = conversions.where(F.col("app") == app).select(F.col("id").alias("conv_id"), "order_id")
    return (base.join(u, "conv_id", "left").join(s, "conv_id", "left")
            .select("conv_id", "order_id", F.coalesce("user_id", "session_id").alias("touch_id"),
                    F.when(F.col("user_id").isNotNull(), "user").when(F.col("session_id").isNotNull(), "session")
                    .alias("tier")))


def ltv_ntile_single_partition(conversions: DataFrame, app: str) -> DataFrame:
    """G5 as ``ntile(100)`` over an unpartitioned window (one task)."""
    per_user = (conversions.where((F.col("app") == app) & F.col("user_id").isNotNull())
                .groupBy("user_id").agg(F.sum("value_inr").alias("ltv")))
    return per_user.withColumn("ltv_bucket", F.ntile(100).over(Window.orderBy("ltv", "user_id")))


def segment_set_algebra(definition: dict, conversions: DataFrame, events: DataFrame, app: str, now: str) -> DataFrame:
    """G14 as one scan per criterion combined with intersect / union / except."""
    d = sg.validate(definition)
    n = F.lit(now).cast("timestamp_ntz")
    conv = conversions.where((F.col("app") == app) & F.col("user_id").isNotNull())
    ev = events.where((F.col("app") == app) & F.col("user_id").isNotNull())
    universe = conv.select("user_id").union(ev.select("user_id")).distinct()

    def since(days):
        return n - F.make_dt_interval(days=F.lit(days))

    def leaf(c):
        k = c["kind"]
        if k in ("order_recency", "first_order_age"):
            agg = F.max("occurred_at") if k == "order_recency" else F.min("occurred_at")
            g = conv.groupBy("user_id").agg(agg.alias("x"))
            return g.where((F.col("x") >= since(c["days"])) if c["op"] == "lte" else (F.col("x") < since(c["days"]))).select("user_id")
        if k == "order_frequency":
            src = conv.where(F.col("occurred_at") >= since(c["window_days"])) if c.get("window_days") else conv
            g = src.groupBy("user_id").agg(F.count(F.lit(1)).alias("x"))
            cmp = {"gte": F.col("x") >= c["count"], "lte": F.col("x") <= c["count"], "eq": F.col("x") == c["count"]}
            return g.where(cmp[c["op"]]).select("user_id")
        if k == "monetary":
            src = conv.where(F.col("occurred_at") >= since(c["window_days"])) if c.get("window_days") else conv
            agg = F.sum("value_inr") if c["metric"] == "total" else F.avg("value_inr")
            g = src.groupBy("user_id").agg(agg.alias("x"))
            v = F.lit(c["value_inr"]).cast("decimal(38,10)")
            return g.where((F.col("x") >= v) if c["op"] == "gte" else (F.col("x") <= v)).select("user_id")
        if k == "ltv_percentile":
            return ltv_ntile_single_partition(conversions, app).where(F.col("ltv_bucket") > c["percentile"]).select("user_id")
        if k == "attribute":
            vals = c["value"] if isinstance(c["value"], list) else [c["value"]]
            pos = conv.where(F.col(c["field"]).isin(*vals)).select("user_id").distinct()
            return universe.subtract(pos) if c["op"] == "neq" else pos
        pred = (F.col("event_name") == c["event"]) & (F.col("occurred_at") >= since(c["window_days"]))
        for p in c.get("props") or []:
            pred = pred & F.coalesce(sg._prop_predicate(p), F.lit(False))
        pos = (ev.where(pred).groupBy("user_id").agg(F.count(F.lit(1)).alias("x"))
               .where(F.col("x") >= (c.get("min_count") or 1)).select("user_id"))
        return pos if c["performed"] else universe.subtract(pos)

    def group(g):
        parts = [group(x) if "criteria" in x else leaf(x) for x in g["criteria"]]
        out = parts[0]
        for p in parts[1:]:
            out = out.intersect(p) if g["op"] == "AND" else out.union(p).distinct()
        return out
    return group(d["group"]).distinct()


def retention_join(events: DataFrame, links: DataFrame, app: str, day_from: str, day_to: str,
                   days=(1, 7, 30)) -> DataFrame:
    """E5 as cohort ⋈ activity with one distinct count per day offset."""
    ev = identified_events(events, links, app, day_from, day_to)
    d = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), F.col("occurred_at")))
    act = ev.select("id", d.alias("d")).distinct()
    coh = act.groupBy("id").agg(F.min("d").alias("cohort_date"))
    j = coh.join(act, "id")
    aggs = [F.count_distinct("id").alias("size")] + [
        F.count_distinct(F.when(F.col("d") == F.date_add("cohort_date", n), F.col("id"))).alias(f"d{n}") for n in days]
    return j.groupBy("cohort_date").agg(*aggs)


def _t(spark: SparkSession, sf_dir: str) -> DriverTables:
    return DriverTables(spark, sf_dir)


def _naive_refresh(spark, sf_dir):
    t = _t(spark, sf_dir)
    out = None
    for i, d in _due_ids():
        m = segment_set_algebra(d, t.conversion, t.app_event, APP, NOW).select(F.lit(i).alias("segment_id"), "user_id")
        out = m if out is None else out.unionByName(m)
    return out


NAIVE = {
    "last_touch": lambda s, d: last_touch_range_join(_t(s, d).conversion, _t(s, d).attribution_touch, APP, LOOKBACK_DAYS),
    "seg_ltv_percentile": lambda s, d: ltv_ntile_single_partition(_t(s, d).conversion, APP).where("ltv_bucket > 90"),
    "segments_refresh": _naive_refresh,
    "retention": lambda s, d: retention_join(_t(s, d).app_event, _t(s, d).identity_link, APP, DAY_FROM, DAY_TO),
    "seg_nested": lambda s, d: segment_set_algebra(SEG_DEFS["seg_nested"], _t(s, d).conversion, _t(s, d).app_event, APP, NOW),
}

__all__ = ["NAIVE", "last_touch_range_join", "ltv_ntile_single_partition", "segment_set_algebra", "retention_join"]
