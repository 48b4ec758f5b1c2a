"""Registered alert / decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as al
from ..operators import attribution as at
from ..operators import metrics as mt
from ..functions.ranking import global_row_number
from .params import APP, LOOKBACK_DAYS, NOW, SPEND_FROM, SPEND_TO
from .q_attribution import RESOLVE_SQL_CTES
from .registry import register

TODAY = "2024-01-06"   # first orders drop sharply after the first week
FIRE_NOW = f"{TODAY} 12:00:00"
APPS = ("services", "society")


def _drop_sql(app):
    return f"""SELECT '{app}' AS app, 'first_order_drop' AS rule_key, 'critical' AS severity, CAST(NULL AS VARCHAR) AS campaign,
  CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS category, 'first_orders_today' AS metric,
  CAST(t AS DOUBLE) AS observed, prev / 7.0 AS threshold,
  'First orders today (' || CAST(t AS VARCHAR) || ') down ' || CAST(CAST(round((1.0 - t / (prev / 7.0)) * 100.0, 0) AS BIGINT) AS VARCHAR)
    || '% vs trailing avg (' || printf('%.1f', prev / 7.0) || ')' AS message
FROM (SELECT count(*) FILTER (WHERE CAST(occurred_at AS DATE) = DATE '{TODAY}') AS t,
             count(*) FILTER (WHERE CAST(occurred_at AS DATE) < DATE '{TODAY}') AS prev
      FROM conversion WHERE app = '{app}' AND is_first_order AND occurred_at >= CAST(DATE '{TODAY}' - 7 AS TIMESTAMP)
        AND occurred_at < CAST(DATE '{TODAY}' + 1 AS TIMESTAMP)) c
WHERE prev / 7.0 > 0 AND (1.0 - t / (prev / 7.0)) * 100.0 >= {al.DROP_THRESHOLD_PCT}"""


@register("rule_first_order_drop", " UNION ALL ".join(_drop_sql(a) for a in APPS), ("conversion",))
def rule_first_order_drop(t):
    out = None
    for a in APPS:
        p = al.rule_first_order_drop(t.conversion, a, TODAY)
        out = p if out is None else out.unionByName(p)
    return out


def _campaign_performance(t):
    """The ads' daily performance as campaign rows (the level that first orders are matched to)."""
    e = t.ad_entity
    ads = e.where(F.col("level") == "ad").select(F.col("id").alias("ad_entity_id"), F.col("parent_external_id").alias("_set"))
    sets = e.where(F.col("level") == "adset").select(F.col("external_id").alias("_set"), F.col("parent_external_id").alias("_campaign"))
    campaigns = e.where(F.col("level") == "campaign").select(F.col("external_id").alias("_campaign"), F.col("id").alias("_id"))
    return (t.ad_performance_daily.join(ads, "ad_entity_id").join(sets, "_set").join(campaigns, "_campaign")
            .groupBy("app", F.col("_id").alias("ad_entity_id"), "stat_date", "channel").agg(F.sum("spend_inr").alias("spend_inr")))


def _cpfo(t):
    res = at.resolve_attribution(t.conversion, t.attribution_touch, t.ad_entity, APP, LOOKBACK_DAYS, resolved_at=NOW)
    return mt.cost_per_first_order(_campaign_performance(t), t.ad_entity, res, APP, SPEND_FROM, SPEND_TO)


def cpfo_sql(level: str) -> str:
    """M6 and L1 over the entities that the spend is stored for, or over their campaigns."""
    spending = {"stored": "JOIN ad_entity e ON e.id = p.ad_entity_id", "campaign": """JOIN ad_entity a ON a.id = p.ad_entity_id
           JOIN ad_entity st ON st.level = 'adset' AND st.external_id = a.parent_external_id
           JOIN ad_entity e ON e.level = 'campaign' AND e.external_id = st.parent_external_id"""}[level]
    return f"""WITH {RESOLVE_SQL_CTES},
 spend AS (SELECT e.id AS ad_entity_id, e.name AS campaign, e.city, e.category, sum(p.spend_inr) AS spend
           FROM ad_performance_daily p {spending}
           WHERE p.app = '{APP}' AND p.stat_date BETWEEN DATE '{SPEND_FROM}' AND DATE '{SPEND_TO}' GROUP BY 1, 2, 3, 4),
 fo AS (SELECT c.attributed_entity_id AS ad_entity_id, count(*) FILTER (WHERE c.is_first_order) AS first_orders
        FROM resolved c WHERE c.app = '{APP}' AND c.occurred_at >= TIMESTAMP '{SPEND_FROM} 00:00:00'
          AND c.occurred_at < CAST(DATE '{SPEND_TO}' + 1 AS TIMESTAMP) AND c.attribution_outcome = 'matched' GROUP BY 1),
 cpfo AS (SELECT s.campaign, s.city, s.category, CAST(s.spend AS DOUBLE) AS spend_inr,
            coalesce(fo.first_orders, 0) AS first_orders,
            CASE WHEN coalesce(fo.first_orders, 0) > 0 THEN CAST(round(CAST(s.spend AS DECIMAL(24,2)) / fo.first_orders, 2) AS DOUBLE) END AS v
          FROM spend s LEFT JOIN fo ON fo.ad_entity_id = s.ad_entity_id),
 proposals AS (SELECT '{APP}' AS app, 'cpfo_high' AS rule_key, 'warn' AS severity, campaign, city, category,
     'cost_per_first_order_inr' AS metric, v AS observed, CAST({float(al.CPFO_THRESHOLD_INR)} AS DOUBLE) AS threshold,
     'Cost per first order ₹' || regexp_replace(CAST(CAST(v AS DECIMAL(38,2)) AS VARCHAR), '\\.?0+$', '') || ' exceeds ₹'
       || '{al.CPFO_THRESHOLD_INR}' || ' for ' || coalesce(campaign, 'unknown campaign') AS message
   FROM cpfo WHERE v IS NOT NULL AND v > {al.CPFO_THRESHOLD_INR})"""


CPFO_SQL = cpfo_sql("campaign")


@register("rule_cost_high", CPFO_SQL + "\nSELECT * FROM proposals",
          ("conversion", "attribution_touch", "ad_entity", "ad_performance_daily"))
def rule_cost_high(t):
    """L1 over M6 on campaign-level spend."""
    return al.rule_cost_high(_cpfo(t), APP)


def _proposals(t):
    out = al.rule_cost_high(_cpfo(t), APP)
    for a in APPS:
        out = out.unionByName(al.rule_first_order_drop(t.conversion, a, TODAY))
    return out


def _prefilled_alerts(t):
    """Alert table before this run: the society drop alert already fired
    today, the services one fired yesterday."""
    p = _proposals(t)
    return p.withColumn("fired_at", F.when(F.col("app") == "society", F.lit(f"{TODAY} 08:00:00"))
                        .otherwise(F.lit("2024-01-05 08:00:00")).cast("timestamp_ntz"))


@register("fire_alerts", CPFO_SQL + f""",
 p AS (SELECT app, rule_key, message FROM proposals UNION ALL {" UNION ALL ".join("SELECT app, rule_key, message FROM (" + _drop_sql(a) + ")" for a in APPS)})
SELECT DISTINCT app, rule_key, message, TIMESTAMP '{FIRE_NOW}' AS fired_at FROM p WHERE app <> 'society'
""", ("conversion", "attribution_touch", "ad_entity", "ad_performance_daily"))
def fire_alerts(t):
    fired = al.fire_alerts(_proposals(t), _prefilled_alerts(t), FIRE_NOW)
    return fired.select("app", "rule_key", "message", "fired_at")


@register("list_alerts", f"""
WITH p AS ({" UNION ALL ".join(_drop_sql(a) for a in APPS)})
SELECT app, rule_key, severity, message FROM p WHERE app = '{APP}'
""", ("conversion",))
def list_alerts(t):
    alerts = _prefilled_alerts(t).unionByName(al.fire_alerts(_proposals(t), _prefilled_alerts(t), FIRE_NOW))
    return al.list_alerts(alerts, APP, severity="critical").select("app", "rule_key", "severity", "message").distinct()


@register("propose_pauses", CPFO_SQL + f""",
 ent AS (SELECT app, name AS campaign, arg_min(channel, id) AS channel, arg_min(level, id) AS level,
                arg_min(external_id, id) AS external_id FROM ad_entity GROUP BY 1, 2)
SELECT p.app, TIMESTAMP '{FIRE_NOW}' AS proposed_at, 'rules' AS source, e.channel, e.level AS entity_level, e.external_id,
  'pause' AS action_type, '{{}}' AS action_params, 'dry_run' AS mode, 'proposed' AS status, p.message AS reason,
  'alert:cpfo_high:' || p.campaign AS correlation_id,
  to_json({{'ruleKey': p.rule_key, 'severity': p.severity, 'scope': {{'campaign': p.campaign, 'city': p.city, 'category': p.category}},
           'metric': p.metric, 'message': p.message}}) AS state_snapshot
FROM proposals p JOIN ent e ON e.app = p.app AND e.campaign = p.campaign WHERE p.campaign IS NOT NULL""",
          ("conversion", "attribution_touch", "ad_entity", "ad_performance_daily"))
def propose_pauses(t):
    """L4 over the fired cost alerts."""
    fired = al.fire_alerts(_proposals(t), _prefilled_alerts(t), FIRE_NOW)
    out = al.propose_pauses(fired, t.ad_entity, FIRE_NOW)
    # without the snapshot's two numbers, whose printing differs between engines (the message holds both)
    return out.withColumn("state_snapshot", F.regexp_replace("state_snapshot", r'"observed":[^,]*,"threshold":[^,]*,', ""))


def _budget_decisions(t):
    """set_budget proposals for every spending ad at its daily average
    spend over the spend window, numbered by external id."""
    spend = (t.ad_performance_daily.where(F.col("app") == APP)
             .groupBy("ad_entity_id")
             # daily average in whole paise, rounded half up with integer arithmetic
             .agg(((F.sum("spend_inr") * 100).cast("long").alias("c")))
             .select("ad_entity_id", (F.expr("(2 * c + 30) div 60") / 100.0).alias("amount")))
    refs = (t.ad_entity.join(spend, t.ad_entity["id"] == spend["ad_entity_id"])
            .select("app", "channel", F.col("level").alias("entity_level"), "external_id",
                    F.lit("budget review").alias("reason"),
                    F.concat(F.lit("budget:"), F.col("external_id")).alias("correlation_id"), "amount"))
    d = al.propose_action(refs.withColumnRenamed("amount", "_amount").withColumn("amount", F.col("_amount")),
                          "set_budget", F.col("_amount"), "human", NOW)
    return global_row_number(d, [], ["external_id"], out="id")


BUDGET_SQL = f"""d AS (SELECT row_number() OVER (ORDER BY e.external_id) AS id, e.app, e.channel, e.level AS entity_level, e.external_id,
    ((2 * CAST(sum(p.spend_inr) * 100 AS BIGINT) + 30) // 60) / 100.0 AS amount
  FROM ad_performance_daily p JOIN ad_entity e ON e.id = p.ad_entity_id WHERE p.app = '{APP}'
  GROUP BY e.app, e.channel, e.level, e.external_id)"""


@register("propose_actions", f"""WITH {BUDGET_SQL}
SELECT id, app, channel, entity_level, external_id, 'set_budget' AS action_type, 'dry_run' AS mode, 'proposed' AS status, amount
FROM d""", ("ad_performance_daily",))
def propose_actions(t):
    d = _budget_decisions(t)
    return d.select("id", "app", "channel", "entity_level", "external_id", "action_type", "mode", "status",
                    F.round(F.get_json_object("action_params", "$.amountInr").cast("decimal(20,6)"), 2)
                    .cast("double").alias("amount"))


@register("approve_decisions", f"""WITH {BUDGET_SQL}
SELECT id, CASE WHEN id BETWEEN 1 AND 5 THEN 'approved' ELSE 'proposed' END AS status,
  CASE WHEN id BETWEEN 1 AND 5 THEN 'operator' END AS approved_by FROM d""", ("ad_performance_daily",))
def approve_decisions(t):
    decisions = _budget_decisions(t)
    approvals = decisions.where(F.col("id").between(1, 5)).select("id", F.lit("operator").alias("approved_by"))
    updated, _rejected = al.approve_decisions(decisions, approvals, NOW)
    return updated.select("id", "status", "approved_by")


@register("list_decisions", f"""WITH {BUDGET_SQL}
SELECT id, external_id FROM d ORDER BY id DESC""", ("ad_performance_daily",))
def list_decisions(t):
    return al.list_decisions(_budget_decisions(t), APP, status="proposed").select("id", "external_id")
