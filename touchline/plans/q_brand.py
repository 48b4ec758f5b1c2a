"""Registered brand-mention, review-trend and state-snapshot queries
(B1–B12, C6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import HOST_PATTERN, TRAILING_PUNCT, URL_PATTERN, alias_pattern_groups, extract_domains
from ..operators import attribution as at
from ..operators import brand as br
from ..operators import metrics as mt
from .params import APP, LOOKBACK_DAYS, NOW, SPEND_FROM, SPEND_TO
from .registry import register

ALIASES = ["ther", "thre"]
GEO_FROM, GEO_TO = "2024-01-01", "2024-01-31"
BRAND, BRAND_DOMAIN = "ExampleBrand", "example.brand"


# ---------------------------------------------------------------------------
# DuckDB pieces
# ---------------------------------------------------------------------------

def _domain_sql(u):
    def host(x):
        h = f"regexp_replace(lower(regexp_extract({x}, '{HOST_PATTERN}', 1)), '^www\\.', '')"
        return f"CASE WHEN contains({h}, '.') THEN {h} END"
    direct = f"CASE WHEN regexp_matches({u}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://') THEN {host(u)} END"
    prefixed = "'https://' || " + u
    return f"coalesce({direct}, {host(prefixed)})"


def _extract_domains_sql(text):
    pat = URL_PATTERN.replace("(?i)", "").replace("'", "''")
    urls = f"regexp_extract_all({text}, '(?i){pat}')"
    stripped = f"regexp_replace(u, '{TRAILING_PUNCT}', '')"
    doms = f"list_transform({urls}, lambda u: {_domain_sql(stripped)})"
    nn = f"list_filter({doms}, lambda d: d IS NOT NULL)"
    return f"list_filter({nn}, lambda x, i: list_position({nn}, x) = i)"   # distinct, first-seen order


def _detect_sql(text):
    cases, excerpts = [], []
    for a in ALIASES:
        pat = alias_pattern_groups(a)
        low = f"lower({text})"
        m0 = f"regexp_extract({low}, '{pat}', 0)"
        pos = f"(strpos({low}, {m0}) + length(regexp_extract({low}, '{pat}', 1)))"
        mlen = f"length(regexp_extract({low}, '{pat}', 2))"
        start = f"greatest(1, {pos} - 60)"
        end = f"least(length({text}) + 1, {pos} + {mlen} + 60)"
        ex = f"regexp_replace(substring({text}, {start}, {end} - {start}), '^\\s+|\\s+$', '', 'g')"
        cases.append(f"WHEN regexp_matches({low}, '{pat}') THEN {ex}")
        excerpts.append(f"regexp_matches({low}, '{pat}')")
    return f"({' OR '.join(excerpts)})", f"CASE {' '.join(cases)} END"


def _brand_sql(d):
    return " OR ".join(f"regexp_matches(lower({d}), '{alias_pattern_groups(a)}')" for a in ALIASES)


MENTIONED, EXCERPT = _detect_sql("text")
OBS_SQL = f"""obs AS (SELECT 'services' AS app, run_at, engine, prompt_key, conv_id, turn, {MENTIONED} AS brand_mentioned,
  {EXCERPT} AS excerpt FROM answers)"""


# ---------------------------------------------------------------------------
# queries
# ---------------------------------------------------------------------------

def _dims(t):
    e = t.ad_entity.where(F.col("app") == APP)
    cities = e.where(F.col("city").isNotNull()).select(F.col("city").alias("name")).distinct() \
        .withColumn("ord", F.col("name"))
    cats = e.where(F.col("category").isNotNull()).select(F.col("category").alias("name")).distinct() \
        .withColumn("ord", F.col("name"))
    return cities, cats


@register("question_grid", f"""
WITH ci AS (SELECT city AS name, row_number() OVER (ORDER BY city) - 1 AS ci FROM (SELECT DISTINCT city FROM ad_entity WHERE app = '{APP}' AND city IS NOT NULL)),
 ca AS (SELECT category AS name, row_number() OVER (ORDER BY category) - 1 AS ki FROM (SELECT DISTINCT category FROM ad_entity WHERE app = '{APP}' AND category IS NOT NULL)),
 n AS (SELECT (SELECT count(*) FROM ci) AS ny, (SELECT count(*) FROM ca) AS nc),
 tm AS (SELECT * FROM (VALUES (0, 'best', 'best {{category}} services in {{city}}'), (1, 'book', 'how do I book {{category}} online in {{city}}')) t(ti, tid, tmpl)),
 g AS (SELECT tm.ti * n.nc * n.ny + ca.ki * n.ny + ci.ci AS i, tm.tid, tm.tmpl, ca.name AS category, ci.name AS city FROM tm, ca, ci, n)
SELECT CAST(0 AS BIGINT) AS ordinal, 'brand|what-is' AS key, 'what is {BRAND}?' AS text, CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS category
UNION ALL SELECT 1, 'brand|legit-check', 'is {BRAND_DOMAIN} a legit home services company in India?', NULL, NULL
UNION ALL SELECT i + 2, tid || '|' || category || '|' || city, replace(replace(tmpl, '{{category}}', category), '{{city}}', city), city, category
FROM g
""", ("ad_entity",))
def question_grid(t):
    cities, cats = _dims(t)
    return br.question_grid(cities, cats, BRAND, BRAND_DOMAIN)


@register("detect_mentions", f"""WITH {OBS_SQL}
SELECT conv_id, turn, engine, brand_mentioned AS mentioned, excerpt FROM obs""", ("answers",))
def detect_mentions(t):
    m = br.detect_mention(F.col("text"), ALIASES)
    return t.answers.select("conv_id", "turn", "engine", m["mentioned"].alias("mentioned"), m["excerpt"].alias("excerpt"))


@register("extract_domains", f"""
SELECT page_id, array_to_string({_extract_domains_sql("url")}, ',') AS domains FROM urls""", ("urls",))
def extract_domains_q(t):
    return t.urls.select("page_id", F.array_join(extract_domains(F.col("url")), ",").alias("domains"))


@register("extract_domains_html", f"""
SELECT page_id, array_to_string({_extract_domains_sql("html")}, ',') AS domains FROM pages""", ())
def extract_domains_html(t):
    """C6 over whole page bodies."""
    return t.raw("pages").select("page_id", F.array_join(extract_domains(F.col("html")), ",").alias("domains"))


@register("classify_citations", f"""
WITH d AS (SELECT page_id, {_extract_domains_sql("url")} AS doms FROM urls)
SELECT page_id, list_filter(doms, lambda x: {_brand_sql("x")})[1] AS brand_domain,
  array_to_string(list_filter(doms, lambda x: NOT ({_brand_sql("x")})), ',') AS competitors FROM d""", ("urls",))
def classify_citations(t):
    c = br.classify_citations(extract_domains(F.col("url")), ALIASES)
    return t.urls.select("page_id", c["brand_domain"].alias("brand_domain"),
                         F.array_join(c["competitors"], ",").alias("competitors"))


def _obs(t):
    return br.build_observations(t.answers, ALIASES, APP)


@register("build_observations", f"""WITH {OBS_SQL}
SELECT obs.conv_id, obs.turn, obs.engine, obs.prompt_key, obs.run_at, obs.brand_mentioned, CAST(NULL AS VARCHAR) AS cited_url,
  CAST(length(a.text) AS INT) AS raw_chars
FROM obs JOIN answers a ON a.conv_id = obs.conv_id AND a.turn = obs.turn""", ("answers",))
def build_observations(t):
    o = _obs(t)
    return o.select("conv_id", "turn", "engine", "prompt_key", "run_at", "brand_mentioned", "cited_url",
                    F.length("raw_response").alias("raw_chars"))


RATE = """CAST(count(*) AS DOUBLE) AS observations, CAST(count(*) FILTER (WHERE brand_mentioned) AS DOUBLE) AS mentions,
  CASE WHEN count(*) > 0 THEN CAST(round(CAST(count(*) FILTER (WHERE brand_mentioned) AS DECIMAL(20,0)) / CAST(count(*) AS DECIMAL(20,0)), 4) AS DOUBLE) END AS mention_rate"""
GEO_WHERE = f"app = '{APP}' AND CAST(run_at AS DATE) BETWEEN DATE '{GEO_FROM}' AND DATE '{GEO_TO}'"


@register("mention_totals", f"WITH {OBS_SQL} SELECT {RATE} FROM obs WHERE {GEO_WHERE}", ("answers",))
def mention_totals(t):
    return br.mention_totals(_obs(t), APP, GEO_FROM, GEO_TO)


@register("mention_by_engine", f"WITH {OBS_SQL} SELECT engine AS dimension, {RATE} FROM obs WHERE {GEO_WHERE} GROUP BY 1 ORDER BY 1",
          ("answers",))
def mention_by_engine(t):
    return br.mention_rate_by(_obs(t), APP, GEO_FROM, GEO_TO, "engine")


for _by, _part in (("category", 2), ("city", 3)):
    def _mk(by):
        return lambda t: br.mention_rate_by(_obs(t), APP, GEO_FROM, GEO_TO, by)
    register(f"mention_by_{_by}", f"""WITH {OBS_SQL}
SELECT split_part(prompt_key, '|', {_part}) AS dimension, {RATE} FROM obs WHERE {GEO_WHERE} AND split_part(prompt_key, '|', 1) <> 'brand'
GROUP BY 1 ORDER BY 1""", ("answers",))(_mk(_by))


@register("latest_run", f"""WITH {OBS_SQL}
SELECT run_at, {RATE} FROM obs WHERE app = '{APP}' AND run_at = (SELECT max(run_at) FROM obs WHERE app = '{APP}') GROUP BY run_at""",
          ("answers",))
def latest_run(t):
    return br.latest_run(_obs(t), APP)


@register("reviews_trend", f"""
SELECT source, CAST(snapshot_date AS VARCHAR) AS snapshot_date, CAST(rating_avg AS DOUBLE) AS rating_avg, rating_count, new_reviews_count
FROM review_observation WHERE app = '{APP}' AND snapshot_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' ORDER BY 2, 1""",
          ("review_observation",))
def reviews_trend(t):
    return br.reviews_trend(t.review_observation, APP, "2024-01-05", "2024-01-20")


@register("reviews_trend_source", f"""
SELECT source, CAST(snapshot_date AS VARCHAR) AS snapshot_date, CAST(rating_avg AS DOUBLE) AS rating_avg, rating_count, new_reviews_count
FROM review_observation WHERE app = '{APP}' AND snapshot_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' AND source = 'play_store' ORDER BY 2, 1""",
          ("review_observation",))
def reviews_trend_source(t):
    return br.reviews_trend(t.review_observation, APP, "2024-01-01", "2024-01-30", "play_store")


def _state(t):
    res = at.resolve_attribution(t.conversion, t.attribution_touch, t.ad_entity, APP, LOOKBACK_DAYS, resolved_at=NOW)
    cac = mt.cac_summary(t.ad_performance_daily, t.ad_entity, t.conversion, APP, SPEND_FROM, SPEND_TO)
    cpfo = mt.cost_per_first_order(t.ad_performance_daily, t.ad_entity, res, APP, SPEND_FROM, SPEND_TO)
    eng = br.mention_rate_by(_obs(t), APP, SPEND_FROM, SPEND_TO, "engine")
    return br.marketing_state(cac, cpfo, eng, APP, SPEND_FROM, SPEND_TO)


def _js(x, scale=2):
    return f"regexp_replace(CAST(CAST({x} AS DECIMAL(38,{scale})) AS VARCHAR), '\\.?0+$', '')" if scale else \
        f"CAST(CAST({x} AS DECIMAL(38,0)) AS VARCHAR)"


def _state_summary_sql():
    from .q_alerts import cpfo_sql
    spend_where = f"p.app = '{APP}' AND p.stat_date BETWEEN DATE '{SPEND_FROM}' AND DATE '{SPEND_TO}'"
    conv_where = (f"c.app = '{APP}' AND c.occurred_at >= TIMESTAMP '{SPEND_FROM} 00:00:00' "
                  f"AND c.occurred_at < CAST(DATE '{SPEND_TO}' + 1 AS TIMESTAMP)")
    return cpfo_sql("stored") + f""",
 tot AS (SELECT CAST((SELECT coalesce(sum(p.spend_inr), 0) FROM ad_performance_daily p JOIN ad_entity e ON e.id = p.ad_entity_id
                      WHERE {spend_where}) AS DECIMAL(24,2)) AS s,
                (SELECT count(*) FILTER (WHERE c.is_first_order) FROM conversion c WHERE {conv_where}) AS f),
 top AS (SELECT * FROM cpfo ORDER BY spend_inr DESC, campaign LIMIT 1)
SELECT '{APP}' AS app,
  'Window {SPEND_FROM}..{SPEND_TO} ({APP}). Spend ₹' || {_js('CAST(tot.s AS DOUBLE)')} || ', first orders ' || {_js('tot.f', 0)}
  || ', blended CAC ' || CASE WHEN tot.f > 0 THEN '₹' || {_js('round(tot.s / tot.f, 2)')} ELSE 'n/a' END || '. '
  || CASE WHEN (SELECT count(*) FROM top) > 0 THEN
       'Top-spend campaign: ' || coalesce((SELECT campaign FROM top), 'unknown') || ' (₹' || {_js('(SELECT spend_inr FROM top)')}
       || ', CPFO ' || coalesce('₹' || {_js('(SELECT v FROM top)')}, 'n/a') || ').'
     ELSE 'No campaign spend yet — connect Meta/Google to populate.' END AS summary
FROM tot"""


@register("state_summary", _state_summary_sql(),
          ("conversion", "attribution_touch", "ad_entity", "ad_performance_daily", "answers"))
def state_summary(t):
    return br.state_summary(_state(t))


def _marketing_state_sql():
    from .q_alerts import cpfo_sql
    spend = f"p.app = '{APP}' AND p.stat_date BETWEEN DATE '{SPEND_FROM}' AND DATE '{SPEND_TO}'"
    orders = f"c.app = '{APP}' AND c.occurred_at >= TIMESTAMP '{SPEND_FROM} 00:00:00' AND c.occurred_at < CAST(DATE '{SPEND_TO}' + 1 AS TIMESTAMP)"
    return cpfo_sql("stored") + f""",
 {OBS_SQL},
 seen AS (SELECT engine, count(*) AS n, count(*) FILTER (WHERE brand_mentioned) AS m FROM obs
          WHERE app = '{APP}' AND CAST(run_at AS DATE) BETWEEN DATE '{SPEND_FROM}' AND DATE '{SPEND_TO}' GROUP BY engine),
 best AS (SELECT row_number() OVER (ORDER BY spend_inr DESC, campaign) AS place, * FROM cpfo QUALIFY place <= {br.TOP_CAMPAIGNS})
SELECT '{APP}' AS app, '{SPEND_FROM}' AS window_from, '{SPEND_TO}' AS window_to,
  (SELECT CAST(sum(p.spend_inr) AS DOUBLE) FROM ad_performance_daily p WHERE {spend}) AS spend_inr,
  (SELECT CAST(count(*) AS DOUBLE) FROM conversion c WHERE c.is_first_order AND {orders}) AS first_orders,
  (SELECT string_agg(campaign || ':' || CAST(spend_inr AS DECIMAL(24,2)) || ':' || CAST(first_orders AS INT), ',' ORDER BY place) FROM best) AS top_campaigns,
  0 AS n_anomalies,
  '{SPEND_FROM}..{SPEND_TO}' AS geo_window, (SELECT CAST(sum(n) AS DOUBLE) FROM seen) AS geo_observations,
  (SELECT string_agg(engine || ':' || n || ':' || m, ',' ORDER BY engine) FROM seen) AS geo_by_engine"""


@register("marketing_state", _marketing_state_sql(), ("conversion", "attribution_touch", "ad_entity", "ad_performance_daily", "answers"))
def marketing_state(t):
    """B11, its nested lists as text."""
    s = _state(t)
    count = lambda c: c.cast("bigint").cast("string")
    return s.select(
        "app", "window_from", "window_to", "performance.spend_inr", "performance.first_orders",
        F.array_join(F.transform("top_campaigns", lambda x: F.concat_ws(":", x["campaign"], x["spend_inr"].cast("decimal(24,2)").cast("string"),
                                                                        count(x["first_orders"]))), ",").alias("top_campaigns"),
        F.size("anomalies").alias("n_anomalies"),
        F.concat_ws("..", "geo_snapshot.window.from", "geo_snapshot.window.to").alias("geo_window"),
        F.col("geo_snapshot.total_observations").alias("geo_observations"),
        F.array_join(F.transform("geo_snapshot.by_engine", lambda x: F.concat_ws(":", x["engine"], count(x["observations"]), count(x["mentions"]))),
                     ",").alias("geo_by_engine"))
