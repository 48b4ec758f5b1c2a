"""Product-event analytics (E1–E5): DAU, totals, top events, ordered funnel,
cohort retention. All identities are the stitched key of A4."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import day_window, pct2
from .identity import with_identity

BUSINESS_ZONE = "Asia/Kolkata"
RETENTION_DAYS = (1, 7, 30)


def _scoped_events(events: DataFrame, app: str, day_from: str, day_to: str) -> DataFrame:
    return events.where((F.col("app") == app) & day_window("occurred_at", day_from, day_to))


def identified_events(events: DataFrame, links: DataFrame, app: str, day_from: str, day_to: str,
                      names: list[str] | None = None, stitch: str = "all") -> DataFrame:
    """In-window events of ``app`` (optionally of some names) with the stitched
    identity ``id``; rows without any identity are dropped."""
    ev = _scoped_events(events, app, day_from, day_to)
    if names is not None:
        ev = ev.where(F.col("event_name").isin(*names))
    ev = ev.select("event_id", "event_name", "occurred_at", "session_id", "user_id")
    lk = links.where(F.col("app") == app)
    return with_identity(ev, lk, row_id="event_id", stitch=stitch).where(F.col("id").isNotNull())


def dau_daily(events: DataFrame, links: DataFrame, app: str, day_from: str, day_to: str,
              approx: bool = False, stitch: str = "all") -> DataFrame:
    """Per day (session-zone date) distinct identities and event rows.
    ``approx=True`` uses a HyperLogLog++ sketch (``approx_count_distinct``,
    no distinct shuffle) for very large days."""
    ev = identified_events(events, links, app, day_from, day_to, stitch=stitch)
    distinct = F.approx_count_distinct("id") if approx else F.count_distinct("id")
    return (ev.groupBy(F.to_date("occurred_at").cast("string").alias("date"))
            .agg(distinct.cast("int").alias("dau"), F.count(F.lit(1)).cast("int").alias("events"))
            .orderBy("date"))


def dau_totals(events: DataFrame, links: DataFrame, app: str, day_from: str, day_to: str,
               stitch: str = "all", approx: bool = False) -> DataFrame:
    """Window-wide distinct identities and events (one row); ``approx``
    as in E1."""
    ev = identified_events(events, links, app, day_from, day_to, stitch=stitch)
    distinct = F.approx_count_distinct("id") if approx else F.count_distinct("id")
    return ev.agg(distinct.cast("int").alias("unique_users"),
                  F.count(F.lit(1)).cast("int").alias("events"))


def events_by_name(events: DataFrame, app: str, day_from: str, day_to: str, top: int | None) -> DataFrame:
    """Event counts per name, most frequent first (name breaks ties), the
    first ``top``, or all for None. Planned as a partial aggregate +
    TakeOrderedAndProject."""
    out = (_scoped_events(events, app, day_from, day_to)
            .groupBy("event_name").agg(F.count(F.lit(1)).cast("int").alias("count"))
            .orderBy(F.desc("count"), "event_name"))
    return out if top is None else out.limit(top)


def ordered_funnel(events: DataFrame, links: DataFrame, app: str, day_from: str, day_to: str,
                   steps: list[str], stitch: str = "all") -> DataFrame:
    """Ordered conversion funnel over 2–6 steps.

    Step 1 is each identity's first in-window time of event 1; step n is the
    first time of event n strictly after step n−1. Built as one row per
    identity that gains a time per step: one scan and one join on the identity
    for each, one aggregate for all counts; an identity's events are never
    collected into a list.
    """
    if not 2 <= len(steps) <= 6:
        raise ValueError("a funnel has 2 to 6 steps")
    ev = identified_events(events, links, app, day_from, day_to, names=list(dict.fromkeys(steps)), stitch=stitch)
    ev = ev.select("id", "event_name", F.col("occurred_at").alias("t"))
    reached = ev.where(F.col("event_name") == steps[0]).groupBy("id").agg(F.min("t").alias("t1"))
    times = ["t1"]
    for i, name in enumerate(steps[1:], start=2):
        nxt = ev.where(F.col("event_name") == name).select("id", "t")
        # a row per identity with the times so far; the least later time joins them
        later = F.min(F.when(F.col("t") > F.col(times[-1]), F.col("t"))).alias(f"t{i}")
        reached = reached.join(nxt, "id", "left").groupBy("id", *times).agg(later)
        times.append(f"t{i}")
    rungs = reached.agg(*[F.count(c).alias(c) for c in times])
    per_step = rungs.select(F.posexplode(F.array(*times)).alias("step", "users")).select((F.col("step") + 1).alias("step"), "users")
    names = F.element_at(F.array(*[F.lit(s) for s in steps]), F.col("step"))
    w = Window.orderBy("step")   # ≤ 6 rows
    first = F.first("users").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    prev = F.lag("users").over(w)
    return per_step.select(
        "step", names.alias("event_name"), F.col("users").cast("int").alias("users"),
        pct2(F.col("users"), first).alias("pct_of_first"),
        F.when(F.col("step") == 1, F.lit(100.0)).otherwise(pct2(F.col("users"), prev)).alias("pct_of_prev"),
    ).orderBy("step")


def retention(events: DataFrame, links: DataFrame, app: str, day_from: str, day_to: str,
              days: tuple[int, ...] = RETENTION_DAYS, cohort: str = "first_seen",
              zone: str = BUSINESS_ZONE, stitch: str = "all") -> DataFrame:
    """E5: cohort retention in the business zone.

    Cohort date = first in-window local date of the identity (``first_seen``)
    or of its first ``cohort`` event; retained at N = active exactly N local
    days later. One aggregate per identity keeps its distinct active days —
    bounded by the window length — so no join and no distinct-count Expand is
    needed; a second aggregate counts per cohort date.
    """
    ev = identified_events(events, links, app, day_from, day_to, stitch=stitch)
    local_day = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("occurred_at")))
    ev = ev.select("id", "event_name", local_day.alias("d"))
    if cohort == "first_seen":
        entry = F.min("d")
    else:
        entry = F.min(F.when(F.col("event_name") == cohort, F.col("d")))
    per_id = (ev.groupBy("id").agg(entry.alias("cohort_date"), F.collect_set("d").alias("active"))
              .where(F.col("cohort_date").isNotNull()))
    aggs = [F.count(F.lit(1)).cast("int").alias("size")]
    for n in days:
        hit = F.array_contains("active", F.date_add("cohort_date", n))
        aggs.append(F.sum(F.when(hit, 1).otherwise(0)).cast("int").alias(f"d{n}"))
    out = per_id.groupBy("cohort_date").agg(*aggs)
    rates = [pct2(F.col(f"d{n}"), F.col("size")).alias(f"rate_d{n}") for n in days]
    return (out.select(F.col("cohort_date").cast("string").alias("cohort_date"), "size",
                       *[f"d{n}" for n in days], *rates)
            .orderBy("cohort_date"))
