"""Guardrail alerts and dry-run decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import day_window
from ..functions.text import js_number

# Defaults of the two rules.
CPFO_THRESHOLD_INR = 500
DROP_THRESHOLD_PCT = 40
ACTION_TYPES = ("pause", "set_budget", "adjust_tcpa")

PROPOSAL_COLS = ["app", "rule_key", "severity", "campaign", "city", "category", "metric", "observed",
                 "threshold", "message"]


def rule_cost_high(cpfo: DataFrame, app: str, threshold: float = CPFO_THRESHOLD_INR) -> DataFrame:
    """L1: one ``warn`` proposal per campaign whose cost per first order is
    above ``threshold`` (rows of operator M6)."""
    v = F.col("cost_per_first_order_inr")
    msg = F.concat(F.lit("Cost per first order ₹"), js_number(v), F.lit(" exceeds ₹"),
                   js_number(F.lit(float(threshold))), F.lit(" for "),
                   F.coalesce(F.col("campaign"), F.lit("unknown campaign")))
    return cpfo.where(v.isNotNull() & (v > threshold)).select(
        F.lit(app).alias("app"), F.lit("cpfo_high").alias("rule_key"), F.lit("warn").alias("severity"),
        "campaign", "city", "category", F.lit("cost_per_first_order_inr").alias("metric"),
        v.cast("double").alias("observed"), F.lit(float(threshold)).alias("threshold"), msg.alias("message"))


def rule_first_order_drop(conversions: DataFrame, app: str, today: str,
                          pct: float = DROP_THRESHOLD_PCT) -> DataFrame:
    """L2: first orders ``today`` against the mean of the 7 previous days;
    ``critical`` when the drop is ≥ ``pct`` percent, silent when the mean is 0."""
    d = F.lit(today).cast("date")
    c = conversions.where((F.col("app") == app) & F.col("is_first_order")
                          & day_window("occurred_at", _day_minus(today, 7), today))
    day = F.to_date("occurred_at")
    counts = c.agg(F.count_if(day == d).alias("t"), F.count_if(day < d).alias("prev"))
    avg = F.col("prev") / F.lit(7.0)
    drop = (F.lit(1.0) - F.col("t") / avg) * 100.0
    msg = F.concat(F.lit("First orders today ("), F.col("t").cast("string"), F.lit(") down "),
                   F.round(drop, 0).cast("long").cast("string"), F.lit("% vs trailing avg ("),
                   F.format_string("%.1f", avg), F.lit(")"))
    return counts.where((avg > 0) & (drop >= pct)).select(
        F.lit(app).alias("app"), F.lit("first_order_drop").alias("rule_key"), F.lit("critical").alias("severity"),
        F.lit(None).cast("string").alias("campaign"), F.lit(None).cast("string").alias("city"),
        F.lit(None).cast("string").alias("category"), F.lit("first_orders_today").alias("metric"),
        F.col("t").cast("double").alias("observed"), avg.alias("threshold"), msg.alias("message"))


def _day_minus(day: str, n: int) -> str:
    import datetime as dt
    return (dt.date.fromisoformat(day) - dt.timedelta(days=n)).isoformat()


def fire_alerts(proposals: DataFrame, alerts: DataFrame, now: str) -> DataFrame:
    """L3: proposals not already fired today (same app, rule and message),
    as new alert rows stamped ``fired_at = now``. Equal proposals of one run
    (two ads with one name and cost) fire once, with the least of their other
    columns."""
    n = F.lit(now).cast("timestamp_ntz")
    key = ["app", "rule_key", "message"]
    rest = [c for c in proposals.columns if c not in key]
    proposals = (proposals.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r"))
                 .select(*[F.col(f"_r.{c}").alias(c) if c in rest else F.col(c) for c in proposals.columns]))
    today = alerts.where(F.to_date("fired_at") == F.to_date(n)).select("app", "rule_key", "message")
    return (proposals.join(today, ["app", "rule_key", "message"], "left_anti")
            .withColumn("fired_at", n))


def state_snapshot() -> Column:
    """The proposal a decision was made from, as JSON (NULL fields are kept)."""
    scope = F.struct("campaign", "city", "category")
    return F.to_json(F.struct(F.col("rule_key").alias("ruleKey"), "severity", scope.alias("scope"), "metric", "observed",
                              "threshold", "message"), {"ignoreNullFields": "false"})


def propose_pauses(fired: DataFrame, entities: DataFrame, now: str) -> DataFrame:
    """L4: a dry-run ``pause`` decision for each fired ``cpfo_high`` alert whose
    campaign name matches an entity exactly (lowest entity id)."""
    by_name = (entities.groupBy("app", F.col("name").alias("campaign"))
               .agg(F.min_by(F.struct("channel", "level", "external_id"), F.col("id")).alias("e")))
    f = fired.where((F.col("rule_key") == "cpfo_high") & F.col("campaign").isNotNull())
    j = f.join(by_name, ["app", "campaign"])
    return propose_action(
        j.select("app", F.col("e.channel").alias("channel"), F.col("e.level").alias("entity_level"),
                 F.col("e.external_id").alias("external_id"), F.col("message").alias("reason"),
                 F.concat(F.lit("alert:cpfo_high:"), F.col("campaign")).alias("correlation_id"),
                 state_snapshot().alias("state_snapshot")),
        "pause", None, "rules", now)


def propose_action(refs: DataFrame, kind: str, amount: Column | float | None, source: str, now: str) -> DataFrame:
    """Dry-run decision rows (``mode = dry_run``, ``status = proposed``)
    for entity refs ``(app, channel, entity_level, external_id, reason,
    correlation_id[, state_snapshot])``; ``amount`` is the budget / target CPA
    in INR; a ref without a snapshot stores NULL."""
    if kind not in ACTION_TYPES:
        raise ValueError(kind)
    if kind == "pause":
        params = F.lit("{}")
    else:
        a = amount if isinstance(amount, Column) else F.lit(amount)
        params = F.to_json(F.struct(a.cast("double").alias("amountInr")))
    snapshot = F.col("state_snapshot") if "state_snapshot" in refs.columns else F.lit(None).cast("string")
    return refs.select("app", F.lit(now).cast("timestamp_ntz").alias("proposed_at"), F.lit(source).alias("source"),
                       "channel", "entity_level", "external_id", F.lit(kind).alias("action_type"),
                       params.alias("action_params"), F.lit("dry_run").alias("mode"),
                       F.lit("proposed").alias("status"), "reason", "correlation_id", snapshot.alias("state_snapshot"))


def approve_decisions(decisions: DataFrame, approvals: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """``proposed`` → ``approved`` for the requested ids; returns the
    updated decisions and the rejected requests (unknown id or not proposed).
    ``approvals`` has ``id`` and ``approved_by``; an id asked for more than
    once is approved once (by the least name), and decisions that nobody asked
    for keep their approver and time."""
    a = approvals.groupBy("id").agg(F.min("approved_by").alias("_by"), F.lit(True).alias("_req"))
    for c, kind in (("approved_by", "string"), ("approved_at", "timestamp_ntz")):
        if c not in decisions.columns:
            decisions = decisions.withColumn(c, F.lit(None).cast(kind))
    j = decisions.join(a, "id", "left")
    ok = F.coalesce(F.col("_req"), F.lit(False)) & (F.col("status") == "proposed")
    updated = (j.withColumn("approved_by", F.when(ok, F.col("_by")).otherwise(F.col("approved_by")))
               .withColumn("approved_at", F.when(ok, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("approved_at")))
               .withColumn("status", F.when(ok, F.lit("approved")).otherwise(F.col("status")))
               .drop("_by", "_req"))
    rejected = (approvals.select("id").distinct().join(decisions.select("id", "status"), "id", "left")
                .where(F.col("status").isNull() | (F.col("status") != "proposed"))
                .select("id", F.when(F.col("status").isNull(), F.lit("not found"))
                        .otherwise(F.lit("not in proposed state")).alias("error")))
    return updated, rejected


def list_alerts(alerts: DataFrame, app: str, severity: str | None = None, n: int | None = None) -> DataFrame:
    """Alerts (optionally of one severity), newest first; the newest ``n`` if given."""
    a = alerts.where(F.col("app") == app)
    if severity:
        a = a.where(F.col("severity") == severity)
    a = a.orderBy(F.col("fired_at").desc(), F.col("rule_key"), F.col("message"))
    return a if n is None else a.limit(n)


def list_decisions(decisions: DataFrame, app: str, status: str | None = None, n: int | None = None) -> DataFrame:
    """Decisions (optionally of one status), newest first; the newest ``n`` if given."""
    d = decisions.where(F.col("app") == app)
    if status:
        d = d.where(F.col("status") == status)
    d = d.orderBy(F.col("proposed_at").desc(), F.col("id").desc())
    return d if n is None else d.limit(n)
