"""DuckDB spelling of the fixture bindings (FIXTURES.md §4).

Fixed values: these SQL texts are the binding rules as given in FIXTURES.md;
oracle queries inline the ones they use as CTEs, in dependency order.
"""

from __future__ import annotations

BINDINGS: dict[str, str] = {
    "ad_entity": """
SELECT * FROM (
 SELECT CAST(r_regionkey AS BIGINT) AS id, 'services' AS app, CASE WHEN r_regionkey % 2 = 0 THEN 'meta' ELSE 'google' END AS channel, 'campaign' AS level,
        concat('c', CAST(r_regionkey AS STRING)) AS external_id, CAST(NULL AS STRING) AS parent_external_id,
        concat(replace(lower(r_name), ' ', ''), '_cat', CAST(r_regionkey % 2 AS STRING), '_purchase') AS name,
        replace(lower(r_name), ' ', '') AS city, concat('cat', CAST(r_regionkey % 2 AS STRING)) AS category FROM region
 UNION ALL
 SELECT 1000 + n_nationkey, 'services', CASE WHEN n_regionkey % 2 = 0 THEN 'meta' ELSE 'google' END, 'adset', concat('a', CAST(n_nationkey AS STRING)), concat('c', CAST(n_regionkey AS STRING)),
        concat('set ', CAST(n_nationkey % 7 AS STRING)), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM nation
 UNION ALL
 SELECT 100000 + s_suppkey, 'services', CASE WHEN n_regionkey % 2 = 0 THEN 'meta' ELSE 'google' END, 'ad', concat('s', CAST(s_suppkey AS STRING)), concat('a', CAST(s_nationkey AS STRING)),
        s_name, CAST(NULL AS STRING), CAST(NULL AS STRING) FROM supplier JOIN nation ON n_nationkey = s_nationkey) x""",
    "ad_performance_daily": """
SELECT 'services' AS app, 100000 + l_suppkey AS ad_entity_id, DATE '2024-01-01' + CAST(l_orderkey % 30 AS INT) AS stat_date, e.channel AS channel,
  SUM(CAST(l_extendedprice AS DECIMAL(14,2))) AS spend_inr, SUM(CAST(l_quantity AS BIGINT)) AS impressions, COUNT(*) AS clicks,
  CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DECIMAL(14,2)) AS conversions, SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(14,2)) ELSE CAST(0 AS DECIMAL(14,2)) END) AS conv_value_inr
  FROM lineitem JOIN ad_entity e ON e.id = 100000 + l_suppkey GROUP BY 100000 + l_suppkey, DATE '2024-01-01' + CAST(l_orderkey % 30 AS INT), e.channel""",
    "app_event": """
SELECT CAST(event_id AS STRING) AS event_id, CASE WHEN event_id % 10 = 9 THEN 'society' ELSE 'services' END AS app,
  CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'el_first_open' WHEN event_type = 'view' THEN 'el_add_to_cart' WHEN event_type = 'signup' THEN 'el_signup' ELSE 'charged' END AS event_name,
  ts AS occurred_at, concat('s', CAST(user_id AS STRING), '-', CAST(event_id % 3 AS STRING)) AS session_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS user_id, CASE event_id % 3 WHEN 0 THEN 'android' WHEN 1 THEN 'ios' ELSE 'web' END AS platform, props
  FROM events WHERE event_type IN ('view','signup','purchase')""",
    "identity_link": """
SELECT DISTINCT CASE WHEN event_id % 10 = 9 THEN 'society' ELSE 'services' END AS app, concat('s', CAST(user_id AS STRING), '-', CAST(event_id % 3 AS STRING)) AS session_id, user_id FROM events WHERE event_id % 4 <> 0 AND event_id % 3 <> 2""",
    "attribution_touch": """
SELECT event_id AS id, CASE WHEN event_id % 10 = 9 THEN 'society' ELSE 'services' END AS app, ts AS occurred_at, ts AS received_at,
  CASE event_id % 4 WHEN 0 THEN 'google' WHEN 1 THEN 'meta' WHEN 2 THEN 'ctwa' END AS channel,
  CASE WHEN event_id % 4 = 0 THEN concat('g', CAST(event_id AS STRING)) END AS gclid, CASE WHEN event_id % 4 = 1 THEN concat('f', CAST(event_id AS STRING)) END AS fbclid,
  CASE WHEN event_id % 4 = 2 THEN concat('w', CAST(event_id AS STRING)) END AS ctwa_clid,
  CASE WHEN event_id % 4 = 1 THEN concat('fb.1.', CAST(event_id AS STRING)) END AS fbc, CASE WHEN event_id % 8 = 1 THEN concat('fp.', CAST(event_id AS STRING)) END AS fbp,
  CASE event_id % 4 WHEN 0 THEN 'google' WHEN 1 THEN 'facebook' WHEN 2 THEN 'whatsapp' ELSE 'YouTube_Ads' END AS utm_source,
  CASE WHEN event_type = 'click' THEN 'cpc' ELSE 'qr' END AS utm_medium,
  CASE event_id % 7 WHEN 1 THEN concat('c', CAST(event_id % 5 AS STRING)) WHEN 2 THEN 'AFRICA_CAT0_PURCHASE' WHEN 3 THEN concat('s', CAST(event_id % 10 AS STRING))
    WHEN 4 THEN concat('offline_', CAST(event_id % 3 AS STRING)) WHEN 5 THEN 'america_cat1_leads' WHEN 6 THEN 'asia_cat0_purchase' END AS utm_campaign,
  CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'first_party_click' ELSE 'touch' END AS touch_type, concat('s', CAST(user_id AS STRING), '-', CAST(event_id % 3 AS STRING)) AS session_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS user_id
  FROM events WHERE event_type IN ('click','error')""",
    "conversion": """
SELECT event_id AS id, CASE WHEN event_id % 10 = 9 THEN 'society' ELSE 'services' END AS app, concat('o', CAST(event_id AS STRING)) AS order_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS user_id, ts AS occurred_at, CAST(value AS DECIMAL(10,2)) AS value_inr,
  (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)) = 1 AS is_first_order, CASE event_id % 3 WHEN 0 THEN 'africa' WHEN 1 THEN 'asia' ELSE 'america' END AS city,
  concat('cat', CAST(event_id % 2 AS STRING)) AS category, concat('s', CAST(user_id AS STRING), '-', CAST(event_id % 3 AS STRING)) AS session_id FROM events WHERE event_type = 'purchase'""",
    "conversion_orders": """
SELECT o_orderkey AS id, 'services' AS app, CAST(o_orderkey AS STRING) AS order_id, o_custkey AS user_id, o_orderdate AS occurred_at, CAST(o_totalprice AS DECIMAL(10,2)) AS value_inr,
  (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) = 1 AS is_first_order, lower(n_name) AS city, lower(c_mktsegment) AS category,
  CASE o_orderkey % 3 WHEN 0 THEN 'meta' WHEN 1 THEN 'google' END AS attributed_channel FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
    "lead_event": """
SELECT event_id AS id, CASE WHEN event_id % 10 = 9 THEN 'society' ELSE 'services' END AS app, concat('w', CAST(event_id AS STRING)) AS ctwa_clid, CASE WHEN event_id % 8 = 2 THEN sha256(CAST(user_id AS STRING)) END AS wa_phone_hash,
  concat('L-', CAST(event_id AS STRING)) AS lead_ref, ts AS occurred_at, CASE WHEN event_id % 12 = 2 THEN ts END AS capi_uploaded_at FROM events WHERE event_type IN ('click','error') AND event_id % 4 = 2 AND event_id % 3 <> 1""",
    "event_registry": """
SELECT * FROM (VALUES (1,'services','app','el_first_open','hourly',true),(2,'services','app','el_ghost','daily',true),(3,'services','app','','daily',true),(4,'services','click','','daily',true),(5,'services','conversion','','daily',false),(6,'services','touch','','none',true),(7,'services','notification','','daily',true)) AS r(id, app, source, event_name, expected_frequency, is_active)""",
    "beacon_raw": """
SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'not-a-uuid' ELSE concat('123e4567-e89b-42d3-a456-', lpad(CAST(event_id AS STRING), 12, '0')) END AS session_id,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'first_party_click' WHEN 2 THEN 'lead' ELSE 'touch' END AS touch_type, CASE WHEN event_id % 3 = 0 THEN concat(' camp_', CAST(event_id % 9 AS STRING), ' ') END AS utm_campaign,
  CASE WHEN event_id % 4 = 0 THEN concat('g', CAST(event_id AS STRING)) END AS gclid, event_id % 2 = 0 AS consent, ts AS occurred_at FROM events""",
    "answers": """
SELECT CASE conv_id % 4 WHEN 0 THEN 'claude' WHEN 1 THEN 'chatgpt' WHEN 2 THEN 'gemini' ELSE 'perplexity' END AS engine,
  CASE WHEN conv_id % 11 = 0 THEN 'brand|what-is' ELSE concat(CASE WHEN conv_id % 2 = 0 THEN 'best' ELSE 'book' END, '|cat', CAST(conv_id % 3 AS STRING), '|city', CAST(conv_id % 5 AS STRING)) END AS prompt_key,
  TIMESTAMP '2024-01-01 03:30:00' + (conv_id % 4) * INTERVAL 7 DAYS AS run_at, conv_id, turn, text FROM conversations WHERE role = 'assistant'""",
    "review_observation": """
SELECT 'services' AS app, CASE l_suppkey % 3 WHEN 0 THEN 'google_business' WHEN 1 THEN 'play_store' ELSE 'app_store' END AS source, DATE '2024-01-01' + CAST(l_orderkey % 30 AS INT) AS snapshot_date,
  CAST(1 + (SUM(l_orderkey) % 400) / 100.0 AS DECIMAL(3,2)) AS rating_avg, CAST(COUNT(*) AS INT) AS rating_count, CAST(NULL AS INT) AS new_reviews_count FROM lineitem GROUP BY 2, 3""",
    "urls": "SELECT page_id, url FROM pages",
}

# Which bindings each binding reads (for CTE ordering).
DEPENDS = {"ad_performance_daily": ["ad_entity"]}


def with_bindings(body: str, *names: str) -> str:
    """Prefix ``body`` (which may itself start with ``WITH``-less CTE text
    given as ``name AS (...)`` pieces joined by the caller) with the binding
    CTEs it needs."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({BINDINGS[n]}\n)" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
