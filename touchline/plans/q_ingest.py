"""Registered ingest / validation / upsert queries (S, V, C, U families).

Inputs the parquet does not hold (batches, targets, raw report shapes) are
derived from the bound tables by residue rules on their ids (FIXTURES §5);
the oracle applies the same rules to the scalar columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import infer_channel, infer_channel_from_source, parse_campaign_name
from ..operators import identity as idt
from ..functions.ranking import global_row_number
from ..operators import ingest as ig
from ..sources.sinks import KeyedTable, upsert_performance_days
from ..sources.tables import drop_event_months, write_events
from ..sources.versions import VersionedTable
from ..streaming.ingest import scratch
from .params import APP
from .q_attribution import CH
from .registry import BODIES, register

NOW_EVENTS = "2024-01-20 00:00:00"
RECEIVED = "2024-01-31 00:00:00"


def _reasons_sql(rules):
    return "concat_ws(',', " + ", ".join(f"CASE WHEN coalesce({c}, false) THEN '{n}' END" for n, c in rules) + ")"


def _reasons(df):
    return df.withColumn("reasons", F.array_join("reasons", ","))


# ---------------------------------------------------------------------------
# validators (V1–V4)
# ---------------------------------------------------------------------------

def _conv_batch(t):
    c = t.conversion
    i = F.col("id")
    return c.select(
        "id", "app", F.when(i % 17 == 0, F.lit("")).otherwise(F.col("order_id")).alias("order_id"), "user_id",
        F.when(i % 7 == 0, -F.col("value_inr")).otherwise(F.col("value_inr")).alias("value_inr"), "is_first_order",
        F.when(i % 11 == 0, F.lit("fax")).alias("action_source"), "occurred_at",
        F.when(i % 13 == 0, F.lit("sms")).alias("messaging_channel"),
        F.lit(None).cast("string").alias("ctwa_clid"))


CONV_BATCH_SQL = """cb AS (SELECT id, app, CASE WHEN id % 17 = 0 THEN '' ELSE order_id END AS order_id, user_id,
  CASE WHEN id % 7 = 0 THEN -value_inr ELSE value_inr END AS value_inr, is_first_order,
  coalesce(CASE WHEN id % 11 = 0 THEN 'fax' END, 'app') AS action_source, occurred_at,
  CASE WHEN id % 13 = 0 THEN 'sms' END AS messaging_channel, CAST(NULL AS VARCHAR) AS ctwa_clid FROM conversion)"""
CONV_RULES = [("app", "app IS NULL OR app NOT IN ('services', 'society')"),
              ("order_id", "order_id IS NULL OR length(order_id) < 1"), ("user_id", "user_id IS NOT NULL AND user_id <= 0"),
              ("value_inr", "value_inr IS NULL OR value_inr < 0"), ("is_first_order", "is_first_order IS NULL"),
              ("action_source", "action_source NOT IN ('website', 'app', 'system_generated', 'business_messaging')"),
              ("occurred_at", "occurred_at IS NULL"), ("ctwa_clid", "length(ctwa_clid) < 1 OR length(ctwa_clid) > 512"),
              ("messaging_channel", "messaging_channel NOT IN ('whatsapp')")]


@register("validate_conversions", f"WITH {CONV_BATCH_SQL} SELECT id, {_reasons_sql(CONV_RULES)} AS reasons FROM cb",
          ("conversion",))
def validate_conversions(t):
    return _reasons(ig.validate_conversions(_conv_batch(t))).select("id", "reasons")


TOUCH_RULES = [("app", "app IS NULL OR app NOT IN ('services', 'society')"),
               ("session_id", "session_id IS NULL OR length(session_id) < 1"),
               ("user_id", "user_id IS NOT NULL AND user_id <= 0"),
               ("channel", "channel NOT IN ('google', 'meta', 'ctwa')"),
               ("touch_type", "touch_type NOT IN ('touch', 'first_party_click', 'lead')"),
               ("ctwa_clid", "length(ctwa_clid) < 1 OR length(ctwa_clid) > 512"),
               ("wa_phone_hash", "NOT regexp_matches(wa_phone_hash, '^[0-9a-f]{64}$')")]


@register("validate_touches", f"""WITH tb AS (SELECT id, app, CASE WHEN id % 19 = 0 THEN '' ELSE session_id END AS session_id, user_id,
  CASE WHEN id % 13 = 0 THEN 'tiktok' ELSE channel END AS channel, coalesce(CASE WHEN id % 23 = 0 THEN 'impression' ELSE touch_type END, 'touch') AS touch_type,
  ctwa_clid, CASE WHEN id % 9 = 0 THEN 'XYZ' WHEN id % 9 = 1 THEN sha256(CAST(id AS VARCHAR)) END AS wa_phone_hash FROM attribution_touch)
SELECT id, {_reasons_sql(TOUCH_RULES)} AS reasons FROM tb""", ("attribution_touch",))
def validate_touches(t):
    i = F.col("id")
    b = t.attribution_touch.select(
        "id", "app", F.when(i % 19 == 0, F.lit("")).otherwise(F.col("session_id")).alias("session_id"), "user_id",
        F.when(i % 13 == 0, F.lit("tiktok")).otherwise(F.col("channel")).alias("channel"),
        F.when(i % 23 == 0, F.lit("impression")).otherwise(F.col("touch_type")).alias("touch_type"), "ctwa_clid",
        F.when(i % 9 == 0, F.lit("XYZ")).when(i % 9 == 1, F.sha2(i.cast("string"), 256)).alias("wa_phone_hash"),
        F.lit(None).cast("boolean").alias("consent"))
    return _reasons(ig.validate_touches(b)).select("id", "reasons")


LEAD_RULES = [("app", "app IS NULL OR app NOT IN ('services', 'society')"),
              ("ctwa_clid", "ctwa_clid IS NULL OR length(ctwa_clid) < 1 OR length(ctwa_clid) > 512"),
              ("wa_phone_hash", "NOT regexp_matches(wa_phone_hash, '^[0-9a-f]{64}$')"),
              ("lead_ref", "length(lead_ref) > 64")]


@register("validate_leads", f"""WITH lb AS (SELECT id, app, ctwa_clid, CASE WHEN id % 7 = 0 THEN upper(wa_phone_hash) ELSE wa_phone_hash END AS wa_phone_hash,
  CASE WHEN id % 5 = 0 THEN repeat(lead_ref, 12) ELSE lead_ref END AS lead_ref FROM lead_event)
SELECT id, {_reasons_sql(LEAD_RULES)} AS reasons FROM lb""", ("lead_event",))
def validate_leads(t):
    i = F.col("id")
    b = t.lead_event.select("id", "app", "ctwa_clid",
                            F.when(i % 7 == 0, F.upper("wa_phone_hash")).otherwise(F.col("wa_phone_hash")).alias("wa_phone_hash"),
                            F.when(i % 5 == 0, F.repeat("lead_ref", 12)).otherwise(F.col("lead_ref")).alias("lead_ref"))
    return _reasons(ig.validate_leads(b)).select("id", "reasons")


EVENT_RULES = [("event_id", "event_id IS NULL OR NOT regexp_matches(event_id, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')"),
               ("event_name", "event_name IS NULL OR length(event_name) < 1 OR length(event_name) > 64 OR NOT regexp_matches(event_name, '^[a-z0-9_]+$')"),
               ("occurred_at", "occurred_at IS NULL"), ("session_id", "length(session_id) > 64"),
               ("user_id", "user_id IS NOT NULL AND user_id <= 0"), ("platform", "platform NOT IN ('android', 'ios', 'web')"),
               ("app_version", "length(app_version) > 32")]


def _uuid_events(t):
    n = F.col("event_id").cast("long")
    return t.app_event.select(
        n.alias("n"), F.when(n % 17 == 0, F.lit("bad-id"))
        .otherwise(F.concat(F.lit("123e4567-e89b-42d3-a456-"), F.lpad(n.cast("string"), 12, "0"))).alias("event_id"),
        "app", F.when(n % 23 == 0, F.lit("Bad-Name")).otherwise(F.col("event_name")).alias("event_name"),
        "occurred_at", "session_id", "user_id", "platform",
        F.when(n % 29 == 0, F.repeat(F.lit("9"), 40)).otherwise(F.lit("1.0.0")).alias("app_version"), "props")


UUID_EVENTS_SQL = """ue AS (SELECT CAST(event_id AS BIGINT) AS n, CASE WHEN CAST(event_id AS BIGINT) % 17 = 0 THEN 'bad-id'
  ELSE '123e4567-e89b-42d3-a456-' || lpad(event_id, 12, '0') END AS event_id, app,
  CASE WHEN CAST(event_id AS BIGINT) % 23 = 0 THEN 'Bad-Name' ELSE event_name END AS event_name, occurred_at, session_id, user_id, platform,
  CASE WHEN CAST(event_id AS BIGINT) % 29 = 0 THEN repeat('9', 40) ELSE '1.0.0' END AS app_version FROM app_event)"""


@register("validate_events", f"WITH {UUID_EVENTS_SQL} SELECT n AS id, {_reasons_sql(EVENT_RULES)} AS reasons FROM ue",
          ("app_event",))
def validate_events(t):
    return _reasons(ig.validate_events(_uuid_events(t))).select(F.col("n").alias("id"), "reasons")


# ---------------------------------------------------------------------------
# beacon gate (S11) and scalar enrichments
# ---------------------------------------------------------------------------

SAN_NOW = "2024-01-20 00:00:00"


@register("sanitize_touches", f"""
SELECT event_id, CASE WHEN trim(session_id) <> '' AND length(trim(session_id)) <= 64 THEN trim(session_id) END AS session_id,
  coalesce(touch_type, 'touch') AS touch_type, consent,
  CASE WHEN trim(utm_campaign) <> '' THEN trim(utm_campaign) END AS utm_campaign,
  CASE WHEN consent AND trim(gclid) <> '' THEN trim(gclid) END AS gclid,
  CASE WHEN occurred_at >= TIMESTAMP '{SAN_NOW}' - INTERVAL 30 DAY AND occurred_at <= TIMESTAMP '{SAN_NOW}' + INTERVAL 10 MINUTE THEN occurred_at END AS occurred_at,
  CASE WHEN NOT regexp_matches(coalesce(trim(session_id), ''), '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$') THEN 'session_id'
       WHEN coalesce(touch_type, 'touch') NOT IN ('touch', 'first_party_click') THEN 'touch_type'
       WHEN NOT (coalesce(trim(utm_campaign) <> '', false) OR coalesce(consent AND trim(gclid) <> '', false)
                 OR coalesce(NOT consent AND gclid <> '', false)) THEN 'no_signal' END AS reject_reason
FROM beacon_raw""", ("beacon_raw",))
def sanitize_touches(t):
    s = ig.sanitize_touches(t.beacon_raw, SAN_NOW)
    return s.select("event_id", "session_id", "touch_type", "consent", "utm_campaign", "gclid", "occurred_at",
                    "reject_reason")


PARSE_SQL = """list_transform(string_split(name, '_'), lambda x: lower(trim(x)))"""


@register("parse_campaign_name", f"""
WITH p AS (SELECT id, name, {PARSE_SQL} AS parts FROM ad_entity)
SELECT id, CASE WHEN name <> '' THEN nullif(parts[1], '') END AS city, CASE WHEN name <> '' THEN nullif(parts[2], '') END AS category,
  CASE WHEN name <> '' THEN nullif(parts[3], '') END AS objective,
  coalesce(name <> '' AND len(parts) >= 3 AND nullif(parts[1], '') IS NOT NULL AND nullif(parts[2], '') IS NOT NULL AND nullif(parts[3], '') IS NOT NULL, false) AS parsed_ok
FROM p""", ("ad_entity",))
def parse_campaign_name_q(t):
    p = parse_campaign_name(F.col("name"))
    return t.ad_entity.select("id", p["city"].alias("city"), p["category"].alias("category"),
                              p["objective"].alias("objective"), p["parsed_ok"].alias("parsed_ok"))


@register("parse_campaign_name_touches", f"""
WITH p AS (SELECT id, utm_campaign AS name, list_transform(string_split(utm_campaign, '_'), lambda x: lower(trim(x))) AS parts FROM attribution_touch)
SELECT id, CASE WHEN name <> '' THEN nullif(parts[1], '') END AS city, CASE WHEN name <> '' THEN nullif(parts[2], '') END AS category,
  CASE WHEN name <> '' THEN nullif(parts[3], '') END AS objective,
  coalesce(name <> '' AND len(parts) >= 3 AND nullif(parts[1], '') IS NOT NULL AND nullif(parts[2], '') IS NOT NULL AND nullif(parts[3], '') IS NOT NULL, false) AS parsed_ok
FROM p""", ("attribution_touch",))
def parse_campaign_name_touches(t):
    p = parse_campaign_name(F.col("utm_campaign"))
    return t.attribution_touch.select("id", p["city"].alias("city"), p["category"].alias("category"),
                                      p["objective"].alias("objective"), p["parsed_ok"].alias("parsed_ok"))


@register("campaign_name_lint", f"""
WITH p AS (SELECT level, name, {PARSE_SQL} AS parts FROM ad_entity)
SELECT level, coalesce(name <> '' AND len(parts) >= 3 AND nullif(parts[1], '') IS NOT NULL AND nullif(parts[2], '') IS NOT NULL AND nullif(parts[3], '') IS NOT NULL, false) AS parsed_ok,
  count(*) AS entities FROM p GROUP BY 1, 2""", ("ad_entity",))
def campaign_name_lint(t):
    return ig.campaign_name_lint(t.ad_entity)


@register("infer_channel", f"""
SELECT id, CASE WHEN nullif(gclid, '') IS NOT NULL THEN 'google' WHEN nullif(fbclid, '') IS NOT NULL OR nullif(fbc, '') IS NOT NULL THEN 'meta' END AS from_click_ids,
  {CH.format(p='')} AS mapped_channel FROM attribution_touch""", ("attribution_touch",))
def infer_channel_q(t):
    tt = t.attribution_touch.withColumn("gbraid", F.lit(None).cast("string")).withColumn("wbraid", F.lit(None).cast("string"))
    return tt.select("id", infer_channel().alias("from_click_ids"),
                     F.coalesce(infer_channel(), infer_channel_from_source("utm_source")).alias("mapped_channel"))


@register("assert_currency", """
SELECT external_id, CASE WHEN id % 5 = 0 THEN 'USD' WHEN id % 2 = 0 THEN 'inr' END AS currency FROM ad_entity WHERE id % 5 = 0""",
          ("ad_entity",))
def assert_currency(t):
    """C4: the quarantined rows (currency other than INR, case-insensitive)."""
    e = t.ad_entity.withColumn("currency", F.when(F.col("id") % 5 == 0, F.lit("USD"))
                               .when(F.col("id") % 2 == 0, F.lit("inr")))
    _ok, bad = ig.assert_currency(e, "INR")
    return bad.select("external_id", "currency")


# ---------------------------------------------------------------------------
# report normalisation
# ---------------------------------------------------------------------------

def _insights(t):
    """Ad-performance facts packed into the social insights row shape: string
    numbers, action arrays (one non-purchase action per row), string dates;
    one residue loses its ad id."""
    p = t.ad_performance_daily.join(t.ad_entity.select(F.col("id").alias("ad_entity_id"), "external_id"), "ad_entity_id")
    act = "array<struct<action_type:string,value:string>>"
    drop = (F.col("ad_entity_id") % 13 == 0) & (F.dayofmonth("stat_date") == 5)
    return p.select(
        F.when(~drop, F.col("external_id")).alias("ad_id"), F.col("spend_inr").cast("string").alias("spend"),
        F.col("impressions").cast("string").alias("impressions"), F.col("clicks").cast("string").alias("clicks"),
        F.array(F.struct(F.lit("purchase").alias("action_type"), F.col("conversions").cast("string").alias("value")),
                F.struct(F.lit("link_click").alias("action_type"), F.col("clicks").cast("string").alias("value")))
        .cast(act).alias("actions"),
        F.array(F.struct(F.lit("omni_purchase").alias("action_type"), F.col("conv_value_inr").cast("string").alias("value")),
                F.struct(F.lit("view_content").alias("action_type"), F.lit("7.5").alias("value"))).cast(act).alias("action_values"),
        F.col("stat_date").cast("string").alias("date_start"))


@register("social_performance", """
SELECT e.external_id, p.stat_date, CAST(p.spend_inr AS DOUBLE) AS spend_inr, CAST(p.impressions AS BIGINT) AS impressions, p.clicks,
  CAST(p.conversions AS DOUBLE) AS conversions, CAST(p.conv_value_inr AS DOUBLE) AS conv_value_inr
FROM ad_performance_daily p JOIN ad_entity e ON e.id = p.ad_entity_id WHERE NOT (p.ad_entity_id % 13 = 0 AND day(p.stat_date) = 5)""",
          ("ad_performance_daily",))
def social_performance(t):
    n = ig.normalize_social_performance(_insights(t))
    return n.select("external_id", "stat_date", F.col("spend_inr").cast("double").alias("spend_inr"), "impressions",
                    "clicks", F.col("conversions").cast("double").alias("conversions"),
                    F.col("conv_value_inr").cast("double").alias("conv_value_inr"))


@register("social_entities", """
SELECT level, external_id, parent_external_id, name, 'ACTIVE' AS status,
  CAST(CAST(250000 + id AS DECIMAL(20,2)) / 100 AS DECIMAL(14,2)) AS current_daily_budget_inr FROM ad_entity""", ("ad_entity",))
def social_entities(t):
    """The entity table packed into the three social entity lists (budget
    in minor units), normalised back into one frame."""
    e = t.ad_entity

    def entity_list(level, parent=None):
        cols = [F.col("external_id").alias("id"), "name", F.lit("ACTIVE").alias("effective_status"),
                (F.lit(250000) + F.col("id")).cast("string").alias("daily_budget")]
        if parent:
            cols.append(F.col("parent_external_id").alias(parent))
        return e.where(F.col("level") == level).select(*cols)
    n = ig.normalize_social_entities(entity_list("campaign"), entity_list("adset", "campaign_id"),
                                     entity_list("ad", "adset_id"))
    return n.select("level", "external_id", "parent_external_id", "name", "status", "current_daily_budget_inr")


def _search_report(t):
    """Ad-level facts packed into search report rows (campaign struct,
    ad-group struct, string metrics in micros); several ad groups share a
    campaign-day. ``row_order`` is the stream order."""
    e = t.ad_entity
    ads = e.where(F.col("level") == "ad").select(F.col("id").alias("ad_entity_id"), F.col("parent_external_id").alias("adset_ext"))
    sets = e.where(F.col("level") == "adset").select(F.col("external_id").alias("adset_ext"), F.col("name").alias("adset_name"),
                                                  F.col("parent_external_id").alias("camp_ext"))
    camps = e.where(F.col("level") == "campaign").select(F.col("external_id").alias("camp_ext"), F.col("name").alias("camp_name"))
    p = t.ad_performance_daily.join(ads, "ad_entity_id").join(sets, "adset_ext").join(camps, "camp_ext")
    return p.select(
        F.struct(F.col("camp_ext").alias("id"), F.col("camp_name").alias("name"), F.lit("ENABLED").alias("status")).alias("campaign"),
        F.struct(F.col("adset_ext").alias("id"), F.col("adset_name").alias("name")).alias("adGroup"),
        F.struct((F.col("spend_inr") * 1000000).cast("decimal(24,0)").cast("string").alias("costMicros"),
                 F.col("impressions").cast("string").alias("impressions"), F.col("clicks").cast("string").alias("clicks"),
                 F.col("conversions").cast("double").alias("conversions"),
                 F.col("conv_value_inr").cast("double").alias("conversionsValue")).alias("metrics"),
        F.struct(F.col("stat_date").cast("string").alias("date")).alias("segments"),
        (F.col("ad_entity_id") * 100 + F.dayofmonth("stat_date")).alias("row_order"))


SEARCH_SQL = """sr AS (SELECT c.external_id AS camp_ext, c.name AS camp_name, s.external_id AS adset_ext, s.name AS adset_name,
  p.stat_date, p.spend_inr, p.impressions, p.clicks, p.conversions, p.conv_value_inr, p.ad_entity_id * 100 + day(p.stat_date) AS row_order
  FROM ad_performance_daily p JOIN ad_entity a ON a.id = p.ad_entity_id AND a.level = 'ad'
  JOIN ad_entity s ON s.external_id = a.parent_external_id AND s.level = 'adset'
  JOIN ad_entity c ON c.external_id = s.parent_external_id AND c.level = 'campaign')"""


@register("search_performance", f"""WITH {SEARCH_SQL}
SELECT camp_ext AS external_id, stat_date, CAST(CAST(sum(spend_inr) AS DECIMAL(14,2)) AS DOUBLE) AS spend_inr,
  CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, round(sum(CAST(conversions AS DOUBLE)), 2) AS conversions,
  round(sum(CAST(conv_value_inr AS DOUBLE)), 2) AS conv_value_inr FROM sr GROUP BY 1, 2""", ("ad_performance_daily",))
def search_performance(t):
    n = ig.normalize_search_performance(_search_report(t))
    return n.select("external_id", "stat_date", F.col("spend_inr").cast("double").alias("spend_inr"), "impressions", "clicks",
                    F.round("conversions", 2).alias("conversions"), F.round("conv_value_inr", 2).alias("conv_value_inr"))


@register("search_entities", f"""WITH {SEARCH_SQL},
 u AS (SELECT 'campaign' AS level, camp_ext AS external_id, CAST(NULL AS VARCHAR) AS parent_external_id, camp_name AS name, row_order FROM sr
       UNION ALL SELECT 'adset', adset_ext, camp_ext, adset_name, row_order FROM sr)
SELECT level, external_id, arg_min(parent_external_id, row_order) AS parent_external_id, arg_min(name, row_order) AS name,
  min(row_order) AS first_row FROM u GROUP BY 1, 2""", ("ad_performance_daily",))
def search_entities(t):
    return ig.extract_search_entities(_search_report(t)).select("level", "external_id", "parent_external_id", "name", "first_row")


# ---------------------------------------------------------------------------
# inserts (S5–S8, S10) and identity upkeep
# ---------------------------------------------------------------------------

def _event_batch(t):
    n = F.col("event_id").cast("long")
    return t.app_event.where((n % 2 == 0) | (n % 3 == 0)).withColumn("received_at", F.col("occurred_at"))


def _event_target(t):
    return t.app_event.where(F.col("event_id").cast("long") % 3 != 0)


CLAMP = f"least(greatest(occurred_at, TIMESTAMP '{NOW_EVENTS}' - INTERVAL 30 DAY), TIMESTAMP '{NOW_EVENTS}' + INTERVAL 1 HOUR)"


@register("ingest_events", f"""
SELECT event_id, {CLAMP} AS occurred_at FROM app_event WHERE CAST(event_id AS BIGINT) % 3 = 0""", ("app_event",))
def ingest_events(t):
    new = ig.ingest_events(_event_batch(t), _event_target(t), NOW_EVENTS)
    return new.select("event_id", "occurred_at")


@register("ingest_events_report", """
SELECT count(*) FILTER (WHERE CAST(event_id AS BIGINT) % 2 = 0 OR CAST(event_id AS BIGINT) % 3 = 0) AS received,
  count(*) FILTER (WHERE CAST(event_id AS BIGINT) % 3 = 0) AS inserted FROM app_event""", ("app_event",))
def ingest_events_report(t):
    b = _event_batch(t)
    return ig.ingest_report(b, ig.ingest_events(b, _event_target(t), NOW_EVENTS))


@register("ingest_conversions", """
SELECT order_id, id % 3 <> 0 AS deduped FROM conversion WHERE id % 2 = 0 OR id % 3 = 0""", ("conversion",))
def ingest_conversions(t):
    c = t.conversion
    _new, flagged = ig.ingest_conversions(c.where((F.col("id") % 2 == 0) | (F.col("id") % 3 == 0)), c.where(F.col("id") % 3 != 0))
    return flagged.select("order_id", "deduped")


@register("ingest_leads", """
SELECT ctwa_clid, occurred_at FROM lead_event WHERE id % 3 = 0""", ("lead_event",))
def ingest_leads(t):
    new = ig.ingest_leads(t.lead_event.where((F.col("id") % 2 == 0) | (F.col("id") % 3 == 0)), t.lead_event.where(F.col("id") % 3 != 0), RECEIVED)
    return new.select("ctwa_clid", "occurred_at")


@register("ingest_touches", f"""
SELECT id, coalesce(CASE WHEN id % 5 = 0 THEN NULL ELSE channel END,
   CASE WHEN nullif(gclid, '') IS NOT NULL THEN 'google' WHEN nullif(fbclid, '') IS NOT NULL OR nullif(fbc, '') IS NOT NULL THEN 'meta' END) AS channel,
  CASE WHEN id % 7 = 0 THEN 'touch' ELSE touch_type END AS touch_type,
  CASE WHEN id % 11 = 0 THEN TIMESTAMP '{RECEIVED}' ELSE occurred_at END AS occurred_at FROM attribution_touch""", ("attribution_touch",))
def ingest_touches(t):
    i = F.col("id")
    b = t.attribution_touch.select(
        "id", F.when(i % 5 != 0, F.col("channel")).alias("channel"), "gclid", "fbclid", "fbc",
        F.when(i % 7 != 0, F.col("touch_type")).alias("touch_type"),
        F.when(i % 11 != 0, F.col("occurred_at")).alias("occurred_at"))
    return ig.ingest_touches(b, RECEIVED).select("id", "channel", "touch_type", "occurred_at")


@register("link_identities", """
SELECT DISTINCT app, session_id, user_id FROM (
  SELECT app, session_id, user_id FROM attribution_touch UNION ALL SELECT app, session_id, user_id FROM conversion
  UNION ALL SELECT app, session_id, user_id FROM app_event) s
WHERE session_id IS NOT NULL AND session_id <> '' AND user_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM identity_link l WHERE l.app = s.app AND l.session_id = s.session_id AND l.user_id = s.user_id)""",
          ("attribution_touch", "conversion", "app_event", "identity_link"))
def link_identities(t):
    return idt.link_identities(t.identity_link, t.attribution_touch, t.conversion, t.app_event)


@register("backfill_touch_users", """
WITH t AS (SELECT * FROM attribution_touch),
 cand AS (SELECT a.id, r.user_id, row_number() OVER (PARTITION BY a.id ORDER BY r.received_at, r.id) AS rn
          FROM t a JOIN t r ON r.app = a.app AND r.session_id = a.session_id AND r.user_id IS NOT NULL
            AND (r.received_at > a.received_at OR (r.received_at = a.received_at AND r.id > a.id))
          WHERE a.user_id IS NULL)
SELECT t.id, coalesce(t.user_id, c.user_id) AS user_id FROM t LEFT JOIN cand c ON c.id = t.id AND c.rn = 1""", ("attribution_touch",))
def backfill_touch_users(t):
    return idt.backfill_touch_users(t.attribution_touch).select("id", "user_id")


@register("first_order_flag", """
WITH b AS (SELECT o_orderkey AS id, o_custkey AS user_id, CAST(epoch(o_orderdate) AS BIGINT) AS created_at FROM orders WHERE o_orderstatus IN ('F', 'P'))
SELECT id, user_id, TIMESTAMP '1970-01-01 00:00:00' + created_at * INTERVAL 1 SECOND AS occurred_at, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) = 1 AS is_first_order FROM b""",
          ())
def first_order_flag(t):
    from ..operators.outbox import epoch_seconds
    o = t.raw("orders")
    bookings = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
                        F.when(F.col("o_orderstatus").isin("F", "P"), F.lit("paid")).otherwise(F.lit("pending")).alias("payment_status"),
                        epoch_seconds(F.col("o_orderdate")).alias("created_at"))
    f = ig.flag_first_orders(bookings)
    return f.select("id", "user_id", "occurred_at", "is_first_order")


# ---------------------------------------------------------------------------
# upserts (U1, U2) and month retention
# ---------------------------------------------------------------------------

ENTITY_NOW = "2024-01-31 00:00:00"


def _entity_target(t):
    e = t.ad_entity.where(F.col("id") % 3 != 0)
    return (e.withColumn("objective", F.lit(None).cast("string")).withColumn("status", F.lit("ACTIVE"))
            .withColumn("current_daily_budget_inr", F.lit(None).cast("decimal(14,2)"))
            .withColumn("currency", F.lit("INR"))
            .withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
            .withColumn("updated_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))


def _entity_batch(t):
    return (t.ad_entity.where((F.col("id") % 2 == 0) | (F.col("id") % 3 == 0))
            .select("app", "channel", "level", "external_id", "parent_external_id",
                    F.concat(F.col("name"), F.lit("_v2")).alias("name"), F.lit("PAUSED").alias("status")))


@register("upsert_entities", """
WITH tgt AS (SELECT * FROM ad_entity WHERE id % 3 <> 0),
 bat AS (SELECT app, channel, level, external_id, parent_external_id, name || '_v2' AS name FROM ad_entity WHERE id % 2 = 0 OR id % 3 = 0),
 mx AS (SELECT max(id) AS m FROM tgt),
 newk AS (SELECT b.*, (SELECT m FROM mx) + row_number() OVER (ORDER BY b.app, b.channel, b.level, b.external_id) AS id
          FROM bat b WHERE NOT EXISTS (SELECT 1 FROM tgt WHERE tgt.app = b.app AND tgt.channel = b.channel AND tgt.level = b.level AND tgt.external_id = b.external_id)),
 merged AS (SELECT t.id, t.external_id, t.level, coalesce(b.name, t.name) AS name, b.name IS NOT NULL AS upd,
                   t.city AS old_city, CASE WHEN b.name IS NOT NULL THEN 'PAUSED' ELSE 'ACTIVE' END AS status
            FROM tgt t LEFT JOIN bat b ON b.app = t.app AND b.channel = t.channel AND b.level = t.level AND b.external_id = t.external_id
            UNION ALL SELECT id, external_id, level, name, true, NULL, 'PAUSED' FROM newk),
 parsed AS (SELECT *, list_transform(string_split(name, '_'), lambda x: lower(trim(x))) AS parts FROM merged)
SELECT id, external_id, level, name, status, CASE WHEN NOT upd THEN old_city WHEN name <> '' THEN nullif(parts[1], '') END AS city,
  CASE WHEN upd AND name <> '' THEN nullif(parts[3], '') END AS objective FROM parsed""", ("ad_entity",))
def upsert_entities(t):
    """U1. The batch renames every entity whose id is divisible by 2 or 3; the others keep their
    stored (unparsed) columns, so the oracle parses only updated names."""
    out = ig.upsert_entities(_entity_target(t), _entity_batch(t), ENTITY_NOW)
    return out.select("id", "external_id", "level", "name", "status", "city", "objective")


def _performance_batch(t):
    p = t.ad_performance_daily
    ent = t.ad_entity.select(F.col("id").alias("ad_entity_id"), "external_id")
    bat = (p.where((F.col("ad_entity_id") % 2 == 0) | (F.col("ad_entity_id") % 3 == 0)).join(ent, "ad_entity_id")
           .select("app", "channel", "external_id", "stat_date", (F.col("spend_inr") + 1).alias("spend_inr"),
                   "impressions", "clicks", "conversions", "conv_value_inr"))
    return bat.unionByName(bat.where(F.col("external_id") == "s2").withColumn("external_id", F.lit("unknown-ad")))


@register("upsert_performance", """
WITH tgt AS (SELECT * FROM ad_performance_daily WHERE ad_entity_id % 3 <> 0),
 bat AS (SELECT p.app, e.channel, e.external_id, p.stat_date, p.spend_inr + 1 AS spend_inr, p.impressions FROM ad_performance_daily p
         JOIN ad_entity e ON e.id = p.ad_entity_id WHERE p.ad_entity_id % 2 = 0 OR p.ad_entity_id % 3 = 0),
 keyed AS (SELECT b.*, e.id AS ad_entity_id FROM bat b JOIN (SELECT app, channel, external_id, min(id) AS id FROM ad_entity GROUP BY 1, 2, 3) e
           ON e.app = b.app AND e.channel = b.channel AND e.external_id = b.external_id)
SELECT ad_entity_id, stat_date, CAST(spend_inr AS DOUBLE) AS spend_inr, CAST(impressions AS BIGINT) AS impressions FROM tgt
WHERE NOT EXISTS (SELECT 1 FROM keyed k WHERE k.app = tgt.app AND k.ad_entity_id = tgt.ad_entity_id AND k.stat_date = tgt.stat_date)
UNION ALL SELECT ad_entity_id, stat_date, CAST(spend_inr AS DOUBLE), CAST(impressions AS BIGINT) FROM keyed""", ("ad_performance_daily",))
def upsert_performance(t):
    p = t.ad_performance_daily
    tgt = p.where(F.col("ad_entity_id") % 3 != 0).withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    out = ig.upsert_performance(tgt, _performance_batch(t), t.ad_entity, ENTITY_NOW)
    return out.select("ad_entity_id", "stat_date", F.col("spend_inr").cast("double").alias("spend_inr"), "impressions")


@register("upsert_performance_table", BODIES["upsert_performance"], ("ad_performance_daily",))
def upsert_performance_table(t):
    """U2 into a stored table: the days of the batch are replaced, the others' files stay."""
    p = t.ad_performance_daily
    stored = p.where(F.col("ad_entity_id") % 3 != 0).withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    table = VersionedTable(t.spark, scratch(t.spark, "performance"), stored.schema, "stat_date")
    table.write(stored, [])
    upsert_performance_days(table, _performance_batch(t), t.ad_entity, ENTITY_NOW)
    return table.read().select("ad_entity_id", "stat_date", F.col("spend_inr").cast("double").alias("spend_inr"), "impressions")


@register("ingest_events_table", BODIES["ingest_events"], ("app_event",))
def ingest_events_table(t):
    """S5 into a stored table by buckets of the event id: the stored events as one batch, then the new ones."""
    target, batch = _event_target(t).withColumn("received_at", F.col("occurred_at")), _event_batch(t)
    table = KeyedTable(t.spark, scratch(t.spark, "keyed-events"), ["event_id"], buckets=16)
    table.insert(target, 0)
    batch = batch.withColumn("occurred_at", ig.clamp_occurred_at(F.col("occurred_at"), F.lit(NOW_EVENTS).cast("timestamp_ntz")))
    return table.insert(batch, 1, ["received_at"]).select("event_id", "occurred_at")


@register("event_month_drop", """
SELECT strftime(occurred_at + INTERVAL 330 MINUTE, '%Y_%m') AS event_month, count(*) AS rows FROM conversion_orders
WHERE strftime(occurred_at + INTERVAL 330 MINUTE, '%Y_%m') BETWEEN '1997_06' AND '1998_08' GROUP BY 1""", ("conversion_orders",))
def event_month_drop(t):
    """U5 on a stored table of the orders: what is left after the months out of retention are dropped."""
    path = scratch(t.spark, "months")
    write_events(t.conversion_orders.withColumn("app", F.lit("services")), path)
    drop_event_months(t.spark, path, "1998-06-15 00:00:00", 13)
    return t.spark.read.parquet(path).groupBy("event_month").agg(F.count(F.lit(1)).alias("rows"))


@register("event_month_retention", """
SELECT strftime(occurred_at + INTERVAL 330 MINUTE, '%Y_%m') AS event_month, count(*) AS rows,
  strftime(occurred_at + INTERVAL 330 MINUTE, '%Y_%m') BETWEEN '1997_06' AND '1998_08' AS retained
FROM conversion_orders GROUP BY 1""", ("conversion_orders",))
def event_month_retention(t):
    """U5/U6 over the orders clock (months 1995–2001), as of 1998-06-15."""
    return ig.retain_event_months(t.conversion_orders, "1998-06-15 00:00:00", 13)


# ---------------------------------------------------------------------------
# review snapshots
# ---------------------------------------------------------------------------

def _review_fetches(t):
    """Store reads derived from orders (one read per order) — lookup-style
    stores carry aggregates, the feed-style store carries the order's line
    items as review entries (a star on most of them)."""
    o = t.raw("orders")
    li = t.raw("lineitem")
    feed = (li.groupBy("l_orderkey")   # ≤ 7 lines per order
            .agg(F.sort_array(F.collect_list(F.struct(
                F.col("l_linenumber").alias("n"),
                F.when(F.col("l_quantity").cast("long") % 7 != 0, (F.col("l_quantity").cast("long") % 5 + 1).cast("int"))
                .alias("star")))).alias("_r"))
            .select(F.col("l_orderkey").alias("o_orderkey"),
                    F.transform("_r", lambda x: F.struct(x["star"].alias("star"))).alias("reviews")))
    src = F.when(F.col("o_orderkey") % 3 == 0, "google_business").when(F.col("o_orderkey") % 3 == 1, "play_store") \
        .otherwise("app_store")
    base = o.select("o_orderkey", src.alias("source"),
                    (F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))).alias("observed_at"),
                    (F.lit(1.0) + (F.col("o_totalprice") % 400) / 100.0).alias("avg_rating"),
                    F.col("o_custkey").cast("int").alias("rating_count"))
    j = base.join(feed, "o_orderkey", "left")
    return j.select(F.lit(APP).alias("app"), "source", "observed_at", "o_orderkey",
                    F.when(F.col("source") != "play_store", F.col("avg_rating")).alias("avg_rating"),
                    F.when(F.col("source") != "play_store", F.col("rating_count")).alias("rating_count"),
                    F.when(F.col("source") == "play_store",
                           F.coalesce("reviews", F.array().cast("array<struct<star:int>>"))).alias("reviews"))


@register("snapshot_reviews", """
WITH f AS (SELECT o.o_orderkey, CASE o.o_orderkey % 3 WHEN 0 THEN 'google_business' WHEN 1 THEN 'play_store' ELSE 'app_store' END AS source,
                  o.o_orderdate + (o.o_orderkey % 1440) * INTERVAL 1 MINUTE AS observed_at,
                  1.0 + (o.o_totalprice % 400) / 100.0 AS avg_rating, CAST(o.o_custkey AS INT) AS rating_count FROM orders o),
 s AS (SELECT l_orderkey, count(*) AS n_entries,
              avg(CASE WHEN CAST(l_quantity AS BIGINT) % 7 <> 0 THEN CAST(l_quantity AS BIGINT) % 5 + 1 END) AS mean_star
       FROM lineitem GROUP BY 1),
 r AS (SELECT f.*, CAST(f.observed_at + INTERVAL 330 MINUTE AS DATE) AS snapshot_date, s.n_entries, s.mean_star,
              row_number() OVER (PARTITION BY f.source, CAST(f.observed_at + INTERVAL 330 MINUTE AS DATE) ORDER BY f.observed_at, f.o_orderkey) AS rn
       FROM f LEFT JOIN s ON s.l_orderkey = f.o_orderkey)
SELECT source, snapshot_date,
  CAST(CASE WHEN source = 'play_store' THEN floor(mean_star * 100.0 + 0.5) / 100.0 ELSE floor(avg_rating * 100.0 + 0.5) / 100.0 END AS DECIMAL(3,2)) AS rating_avg,
  CASE WHEN source = 'play_store' THEN NULL ELSE rating_count END AS rating_count,
  CASE WHEN source = 'play_store' THEN CAST(coalesce(n_entries, 0) AS INT) END AS new_reviews_count
FROM r WHERE rn = 1""", ())
def snapshot_reviews(t):
    f = _review_fetches(t)
    return ig.snapshot_reviews(f, tiebreak="o_orderkey").select("source", "snapshot_date", "rating_avg", "rating_count",
                                                                "new_reviews_count")


# ---------------------------------------------------------------------------
# registry and segment metadata (V5, U7, U8), derived from the event names in use
# ---------------------------------------------------------------------------

NAMES_SQL = "names AS (SELECT app, event_name, min(CAST(event_id AS BIGINT)) AS n, count(*) AS events FROM app_event GROUP BY app, event_name)"
META_NOW = "2024-02-01 00:00:00"


def _names(t):
    return t.app_event.groupBy("app", "event_name").agg(F.min(F.col("event_id").cast("long")).alias("n"), F.count(F.lit(1)).alias("events"))


@register("validate_registry", f"""WITH {NAMES_SQL}
SELECT n AS id, concat_ws(',', CASE WHEN n % 3 = 2 THEN 'source' END, CASE WHEN n % 2 = 0 THEN 'event_name' END,
  CASE WHEN n % 5 = 0 THEN 'expected_frequency' END) AS reasons, coalesce(CASE WHEN n % 5 = 0 THEN 'yearly' END, 'none') AS expected_frequency
FROM names""", ("app_event",))
def validate_registry(t):
    """V5: the names in use as registry rows, some with an unknown source, capitals or an unknown frequency."""
    n = F.col("n")
    batch = _names(t).select(
        n, "app", F.when(n % 3 == 0, "app").when(n % 3 == 1, "click").otherwise("pixel").alias("source"),
        F.when(n % 2 == 0, F.upper("event_name")).otherwise(F.col("event_name")).alias("event_name"),
        F.when(n % 5 == 0, "yearly").alias("expected_frequency"), F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("boolean").alias("is_active"))
    return _reasons(ig.validate_registry(batch)).select(n.alias("id"), "reasons", "expected_frequency")


@register("upsert_registry", f"""WITH {NAMES_SQL},
 tgt AS (SELECT row_number() OVER (ORDER BY event_name) AS id, event_name FROM names WHERE app = '{APP}')
SELECT id, 'app' AS source, event_name, id <> 1 AS is_active, CASE WHEN id = 1 THEN 'seen' ELSE event_name END AS description,
  CASE WHEN id = 1 THEN TIMESTAMP '{META_NOW}' END AS updated_at FROM tgt WHERE id <> 2
UNION ALL SELECT (SELECT max(id) FROM tgt) + row_number() OVER (ORDER BY event_name), 'touch', event_name, true, NULL, TIMESTAMP '{META_NOW}' FROM tgt""",
          ("app_event",))
def upsert_registry(t):
    """U8: the registered names; inserts of all of them (taken) and of as many new ones, an update and a delete."""
    mine = _names(t).where(F.col("app") == APP)
    target = global_row_number(mine, [], ["event_name"], out="id").select(
        F.col("id").cast("long").alias("id"), "app", F.lit("app").alias("source"), "event_name", F.lit("daily").alias("expected_frequency"),
        F.lit(True).alias("is_active"), F.col("event_name").alias("description"))

    def change(op, df, **given):
        kinds = {"id": "long", "app": "string", "source": "string", "event_name": "string", "expected_frequency": "string",
                 "is_active": "boolean", "description": "string"}
        return df.select(F.lit(op).alias("op"), *[given.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
    key = {"app": F.col("app"), "event_name": F.col("event_name")}
    changes = (change("insert", mine, source=F.lit("app"), **key).unionByName(change("insert", mine, source=F.lit("touch"), **key))
               .unionByName(change("update", target.where("id = 1"), id=F.col("id"), description=F.lit("seen"), is_active=F.lit(False)))
               .unionByName(change("delete", target.where("id = 2"), id=F.col("id"))))
    registry, _conflicts = ig.upsert_registry(target, changes, META_NOW)
    return registry.select("id", "source", "event_name", "is_active", "description", "updated_at")


@register("seed_segments", f"""WITH {NAMES_SQL},
 tgt AS (SELECT row_number() OVER (ORDER BY event_name) AS id, event_name AS slug, events FROM names WHERE app = '{APP}')
SELECT id, slug, 'seeded' AS name, 'paused' AS status, CAST(events AS INT) AS last_count FROM tgt
UNION ALL SELECT (SELECT max(id) FROM tgt) + row_number() OVER (ORDER BY slug || '_2'), slug || '_2', 'seeded',
  CASE WHEN id % 2 = 0 THEN 'paused' ELSE 'active' END, NULL FROM tgt""", ("app_event",))
def seed_segments(t):
    """A segment per name in use is seeded again, with a second one new; events are taken to be missing."""
    mine = global_row_number(_names(t).where(F.col("app") == APP), [], ["event_name"], out="id")
    target = mine.select(F.col("id").cast("long").alias("id"), "app", F.col("event_name").alias("slug"), F.lit("old").alias("name"),
                         F.lit("{}").alias("definition"), F.lit(60).alias("refresh_interval_minutes"), F.lit("paused").alias("status"),
                         F.lit(False).alias("is_system"), F.col("events").cast("int").alias("last_count"))

    def specs(slug, needs):
        return mine.select("app", slug.alias("slug"), F.lit("seeded").alias("name"), F.lit("{}").alias("definition"),
                           F.lit(30).alias("refresh_interval_minutes"), needs.alias("needs_events"))
    both = specs(F.col("event_name"), F.lit(False)).unionByName(specs(F.concat("event_name", F.lit("_2")), F.col("id") % 2 == 0))
    return ig.seed_segments(target, both, False, META_NOW).select("id", "slug", "name", "status", "last_count")
