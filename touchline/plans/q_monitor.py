"""Registered stream-health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitor as mo
from .params import APP, NOW
from .registry import register

N = f"TIMESTAMP '{NOW}'"
ROWS = f"""rows AS (
  SELECT 'app' AS source, event_name, occurred_at AS ts FROM app_event WHERE app = '{APP}'
  UNION ALL SELECT 'click', NULL, occurred_at FROM attribution_touch WHERE app = '{APP}' AND touch_type = 'first_party_click'
  UNION ALL SELECT 'touch', NULL, occurred_at FROM attribution_touch WHERE app = '{APP}' AND (touch_type <> 'first_party_click' OR touch_type IS NULL)
  UNION ALL SELECT 'lead', NULL, occurred_at FROM lead_event WHERE app = '{APP}'
  UNION ALL SELECT 'conversion', NULL, occurred_at FROM conversion WHERE app = '{APP}')"""


@register("streams_overview", f"""
WITH {ROWS},
 per_name AS (SELECT source, event_name, count(*) FILTER (WHERE ts >= {N} - INTERVAL 24 HOUR) AS c24,
                     count(*) FILTER (WHERE ts >= {N} - INTERVAL 7 DAY) AS c7, max(ts) AS last_seen, false AS fold
              FROM rows GROUP BY 1, 2),
 folded AS (SELECT source, CAST(NULL AS VARCHAR) AS event_name, sum(c24) AS c24, sum(c7) AS c7, max(last_seen) AS last_seen, true AS fold
            FROM per_name WHERE event_name IS NOT NULL GROUP BY 1),
 streams AS (SELECT * FROM per_name UNION ALL SELECT * FROM folded),
 reg AS (SELECT source AS r_source, nullif(event_name, '') AS r_name, expected_frequency, is_active FROM event_registry
         WHERE app = '{APP}' AND source IN ('app', 'click', 'lead', 'conversion', 'touch')),
 j AS (SELECT * FROM streams s FULL OUTER JOIN reg r ON s.source = r.r_source AND s.event_name IS NOT DISTINCT FROM r.r_name)
SELECT coalesce(source, r_source) AS source, coalesce(event_name, r_name) AS event_name,
  CAST(coalesce(c24, 0) AS INT) AS count_24h, CAST(coalesce(c7, 0) AS INT) AS count_7d, last_seen, expected_frequency, is_active,
  CASE WHEN r_source IS NOT NULL AND NOT is_active THEN 'muted'
       WHEN r_source IS NULL THEN 'unregistered'
       WHEN expected_frequency = 'none' THEN 'ok'
       WHEN last_seen IS NULL OR last_seen < {N} - (CASE expected_frequency WHEN 'hourly' THEN INTERVAL 2 HOUR
            WHEN 'daily' THEN INTERVAL 48 HOUR WHEN 'weekly' THEN INTERVAL 336 HOUR END) THEN 'stale'
       ELSE 'ok' END AS health
FROM j WHERE NOT coalesce(fold, false) OR r_source IS NOT NULL
""", ("app_event", "attribution_touch", "lead_event", "conversion", "event_registry"))
def streams_overview(t):
    return mo.streams_overview(t.app_event, t.attribution_touch, t.lead_event, t.conversion, t.event_registry, APP, NOW)


@register("recent_app", f"""
SELECT event_id, event_name, occurred_at, session_id, user_id, platform, props FROM app_event WHERE app = '{APP}'
ORDER BY occurred_at DESC, event_id DESC LIMIT 50""", ("app_event",))
def recent_app(t):
    return mo.recent_app(t.app_event, APP, 50)


@register("recent_app_by_name", f"""
SELECT event_id, event_name, occurred_at, session_id, user_id, platform, props FROM app_event WHERE app = '{APP}'
AND event_name = 'el_signup' ORDER BY occurred_at DESC, event_id DESC LIMIT 20""", ("app_event",))
def recent_app_by_name(t):
    return mo.recent_app(t.app_event, APP, 20, "el_signup")


@register("recent_clicks", f"""
SELECT id, occurred_at, session_id, user_id, CAST(NULL AS VARCHAR) AS link_id, CAST(NULL AS VARCHAR) AS is_bot,
  CAST(NULL AS VARCHAR) AS device FROM attribution_touch WHERE app = '{APP}' AND touch_type = 'first_party_click'
ORDER BY occurred_at DESC, id DESC LIMIT 50""", ("attribution_touch",))
def recent_clicks(t):
    return mo.recent_clicks(t.attribution_touch, APP, 50)


@register("recent_leads", f"""
SELECT id, occurred_at, lead_ref, capi_uploaded_at IS NOT NULL AS capi_uploaded FROM lead_event WHERE app = '{APP}'
ORDER BY occurred_at DESC, id DESC LIMIT 50""", ("lead_event",))
def recent_leads(t):
    return mo.recent_leads(t.lead_event, APP, 50)


@register("recent_conversions", f"""
SELECT id, occurred_at, session_id, user_id, order_id, CAST(value_inr AS DOUBLE) AS value FROM conversion WHERE app = '{APP}'
ORDER BY occurred_at DESC, id DESC LIMIT 50""", ("conversion",))
def recent_conversions(t):
    return mo.recent_conversions(t.conversion, APP, 50)


@register("recent_touches", f"""
SELECT id, occurred_at, session_id, user_id, channel, utm_source, utm_campaign, gclid IS NOT NULL AS has_gclid,
  fbclid IS NOT NULL AS has_fbclid, ctwa_clid IS NOT NULL AS has_ctwa_clid FROM attribution_touch
WHERE app = '{APP}' AND touch_type <> 'first_party_click' ORDER BY occurred_at DESC, id DESC LIMIT 50""", ("attribution_touch",))
def recent_touches(t):
    return mo.recent_touches(t.attribution_touch, APP, 50)
