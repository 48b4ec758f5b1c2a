"""Spend, CAC and LTV metrics.

Money is aggregated in decimal and cast to double only at the output edge;
ratios are rounded in decimal (half away from zero).

Scale notes: ``ad_entity`` is a dimension (campaigns/adsets/ads) — AQE
broadcasts it when its measured size is under the adaptive threshold and
keeps a shuffle join otherwise. Per-user order revenue is pre-aggregated
before it meets the (much smaller) acquired-user frame, so a heavy buyer is
one row on each side of that join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import day_window, money_ratio

DIMENSIONS = {"city": "city", "category": "category", "campaign": "name"}


def _spend_rows(perf: DataFrame, entities: DataFrame, app: str, day_from: str, day_to: str,
                city: str | None = None, category: str | None = None) -> DataFrame:
    p = perf.where((F.col("app") == app)
                   & F.col("stat_date").between(F.lit(day_from).cast("date"), F.lit(day_to).cast("date")))
    e = entities.select(F.col("id").alias("ad_entity_id"), F.col("name"), F.col("city"), F.col("category"))
    if city is not None:
        e = e.where(F.col("city") == city)
    if category is not None:
        e = e.where(F.col("category") == category)
    return p.join(e, "ad_entity_id")


def _sums() -> list:
    def s(c, alias):
        return F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(alias)
    return [s("spend_inr", "spend_inr"), s("impressions", "impressions"), s("clicks", "clicks"),
            s("conversions", "platform_conversions"), s("conv_value_inr", "conv_value_inr")]


def spend_summary(perf, entities, app, day_from, day_to, city=None, category=None) -> DataFrame:
    """M1: five global sums (0 when nothing matches)."""
    return _spend_rows(perf, entities, app, day_from, day_to, city, category).agg(*_sums())


def spend_breakdown(perf, entities, app, day_from, day_to, dimension: str,
                    city=None, category=None) -> DataFrame:
    """M2–M4: the same sums by entity city / category / name (NULL is a group)."""
    col = DIMENSIONS[dimension]
    return (_spend_rows(perf, entities, app, day_from, day_to, city, category)
            .groupBy(F.col(col).alias(dimension)).agg(*_sums())
            .orderBy(F.desc("spend_inr")))


def _conversions(conv: DataFrame, app: str, day_from: str, day_to: str,
                 city=None, category=None) -> DataFrame:
    c = conv.where((F.col("app") == app) & day_window("occurred_at", day_from, day_to))
    if city is not None:
        c = c.where(F.col("city") == city)
    if category is not None:
        c = c.where(F.col("category") == category)
    return c


def cac_summary(perf, entities, conv, app, day_from, day_to, city=None, category=None) -> DataFrame:
    """M5: spend, first orders, all orders, blended CAC (NULL without first orders).

    The spend total enters the conversion aggregate as a scalar subquery."""
    spend = _spend_rows(perf, entities, app, day_from, day_to, city, category).agg(
        F.coalesce(F.sum("spend_inr"), F.lit(0)).alias("s"))
    fo = _conversions(conv, app, day_from, day_to, city, category).agg(
        F.count_if(F.col("is_first_order")).alias("f"), F.count(F.lit(1)).alias("a"))
    s = spend.scalar()
    return fo.select(
        s.cast("double").alias("spend_inr"), F.col("f").cast("double").alias("first_orders"),
        F.col("a").cast("double").alias("all_orders"),
        F.when(F.col("f") > 0, money_ratio(s, F.col("f"))).alias("blended_cac_inr"))


def cost_per_first_order(perf, entities, resolved_conv, app, day_from, day_to,
                         city=None, category=None) -> DataFrame:
    """M6: per spending entity, spend, matched first orders and cost per first
    order. ``resolved_conv`` carries ``attributed_entity_id`` and
    ``attribution_outcome`` (operator A3)."""
    spend = (_spend_rows(perf, entities, app, day_from, day_to, city, category)
             .groupBy("ad_entity_id", "name", "city", "category")
             .agg(F.sum("spend_inr").alias("spend")))
    fo = (_conversions(resolved_conv, app, day_from, day_to, city, category)
          .where(F.col("attribution_outcome") == "matched")
          .groupBy(F.col("attributed_entity_id").alias("ad_entity_id"))
          .agg(F.count_if(F.col("is_first_order")).alias("first_orders")))
    j = spend.join(fo, "ad_entity_id", "left")
    n = F.coalesce(F.col("first_orders"), F.lit(0))
    return j.select(F.col("name").alias("campaign"), "city", "category",
                    F.col("spend").cast("double").alias("spend_inr"),
                    n.cast("double").alias("first_orders"),
                    F.when(n > 0, money_ratio(F.col("spend"), n)).alias("cost_per_first_order_inr")
                    ).orderBy(F.desc("spend_inr"))


def repeat_rate(conv, app, day_from, day_to, city=None, category=None) -> DataFrame:
    """M7: customers, repeat customers, repeat rate (4 dp), average orders and
    revenue per customer (2 dp) over customers with an order in the window."""
    users = (_conversions(conv, app, day_from, day_to, city, category)
             .where(F.col("user_id").isNotNull())
             .groupBy("user_id").agg(F.count(F.lit(1)).alias("orders"), F.sum("value_inr").alias("revenue")))
    n = F.count(F.lit(1))
    rep = F.count_if(F.col("orders") > 1)
    return users.agg(
        n.cast("double").alias("customers"), rep.cast("double").alias("repeat_customers"),
        F.when(n > 0, F.round(rep.cast("decimal(20,0)") / n.cast("decimal(20,0)"), 4).cast("double"))
         .alias("repeat_rate"),
        F.coalesce(F.round(F.sum("orders").cast("decimal(20,0)") / n.cast("decimal(20,0)"), 2),
                   F.lit(0)).cast("double").alias("avg_orders_per_customer"),
        F.coalesce(F.round(F.sum("revenue") / n.cast("decimal(20,0)"), 2), F.lit(0))
         .cast("double").alias("avg_revenue_per_customer_inr"))


def _acquired(conv, app, day_from, day_to, city, category) -> DataFrame:
    return (_conversions(conv, app, day_from, day_to, city, category)
            .where(F.col("is_first_order") & F.col("user_id").isNotNull()))


def _revenue_to(conv, app, day_to) -> DataFrame:
    """Per-user revenue of every order up to ``day_to`` (no lower bound)."""
    upto = F.col("occurred_at") < F.date_add(F.lit(day_to).cast("date"), 1).cast("timestamp_ntz")
    return (conv.where((F.col("app") == app) & upto & F.col("user_id").isNotNull())
            .groupBy("user_id").agg(F.sum("value_inr").alias("user_revenue")))


def cohort_revenue(conv, entities, app, day_from, day_to, city=None, category=None) -> DataFrame:
    """M8: users whose first order falls in the window, grouped by that
    order's channel and campaign; revenue = all their orders up to ``to``."""
    acq = _acquired(conv, app, day_from, day_to, city, category)
    ent_col = F.col("attributed_entity_id") if "attributed_entity_id" in conv.columns else F.lit(None).cast("bigint")
    acq = acq.select("user_id", F.col("attributed_channel").alias("channel"), ent_col.alias("ad_entity_id"))
    ent = entities.select(F.col("id").alias("ad_entity_id"), F.col("name").alias("campaign"))
    acq = acq.join(ent, "ad_entity_id", "left")
    rows = acq.join(_revenue_to(conv, app, day_to), "user_id")
    rev = F.sum("user_revenue")
    users = F.count_distinct("user_id")
    return (rows.groupBy("channel", "campaign")
            .agg(users.cast("double").alias("customers"),
                 F.coalesce(rev, F.lit(0)).cast("double").alias("cumulative_revenue_inr"),
                 money_ratio(rev, users).alias("ltv_per_customer_inr"))
            .orderBy(F.desc("cumulative_revenue_inr")))


def ltv_cac(conv, perf, entities, app, day_from, day_to, city=None, category=None) -> DataFrame:
    """M9: per channel spend, acquired customers, cohort revenue, LTV, CAC and
    LTV:CAC. Full outer join on channel; a NULL channel never matches."""
    acq = _acquired(conv, app, day_from, day_to, city, category).select(
        "user_id", F.col("attributed_channel").alias("channel"))
    cohort = (acq.join(_revenue_to(conv, app, day_to), "user_id")
              .groupBy("channel")
              .agg(F.count_distinct("user_id").alias("acq"), F.sum("user_revenue").alias("rev")))
    spend = (_spend_rows(perf, entities, app, day_from, day_to, city, category)
             .groupBy("channel").agg(F.coalesce(F.sum("spend_inr"), F.lit(0)).alias("spend")))
    j = cohort.alias("c").join(spend.alias("s"), F.col("c.channel") == F.col("s.channel"), "full")
    return j.select(
        F.coalesce(F.col("c.channel"), F.col("s.channel")).alias("channel"),
        F.coalesce(F.col("spend"), F.lit(0)).cast("double").alias("spend_inr"),
        F.coalesce(F.col("acq"), F.lit(0)).cast("double").alias("acquired_customers"),
        F.coalesce(F.col("rev"), F.lit(0)).cast("double").alias("cohort_revenue_inr"),
        money_ratio(F.col("rev"), F.col("acq")).alias("ltv_per_customer_inr"),
        money_ratio(F.col("spend"), F.col("acq")).alias("cac_inr"),
        money_ratio(F.col("rev"), F.col("spend")).alias("ltv_cac_ratio"),
    ).orderBy(F.desc("spend_inr"))


def ltv_report(conv, perf, entities, app, day_from, day_to, city=None, category=None) -> DataFrame:
    """M7, M9 and M8 as one report, a row per figure: ``section``
    (``repeat``, ``channel``, ``cohort``), the entry's ``channel`` and
    ``campaign``, and one of its figures with its value. No section is folded into a list,
    so a report of any number of campaigns stays spread over the tasks."""
    def figures(df, section):
        names = [c for c in df.columns if c not in ("channel", "campaign")]
        text = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
        return df.select(F.lit(section).alias("section"), text("channel").alias("channel"), text("campaign").alias("campaign"),
                         F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(c).cast("double") for c in names])))
                         .alias("figure", "value"))
    rr = repeat_rate(conv, app, day_from, day_to, city, category)
    lc = ltv_cac(conv, perf, entities, app, day_from, day_to, city, category)
    cr = cohort_revenue(conv, entities, app, day_from, day_to, city, category)
    return figures(rr, "repeat").unionByName(figures(lc, "channel")).unionByName(figures(cr, "cohort"))


def count_first_orders(conv, app, day_from, day_to) -> DataFrame:
    """Number of first orders in the window (one row)."""
    return (_conversions(conv, app, day_from, day_to)
            .agg(F.count_if(F.col("is_first_order")).cast("long").alias("first_orders")))
