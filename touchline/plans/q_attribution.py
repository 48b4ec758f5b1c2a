"""Registered attribution queries (A1–A3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution as at
from ..operators.asof import choose_mode
from .params import APP, LOOKBACK_DAYS, NOW
from .registry import register

L = LOOKBACK_DAYS

# A1 in its naive (range join + row_number) form: the oracle
LAST_TOUCH_CTES = f"""c AS (SELECT * FROM conversion WHERE app = '{APP}'),
 t AS (SELECT * FROM attribution_touch WHERE app = '{APP}'),
 u AS (SELECT c.id AS conv_id, t.id AS touch_id, row_number() OVER (PARTITION BY c.id ORDER BY t.occurred_at DESC, t.received_at DESC, t.id DESC) AS rn
       FROM c JOIN t ON t.user_id = c.user_id AND t.occurred_at <= c.occurred_at AND t.occurred_at >= c.occurred_at - INTERVAL {L} DAY),
 s AS (SELECT c.id AS conv_id, t.id AS touch_id, row_number() OVER (PARTITION BY c.id ORDER BY t.occurred_at DESC, t.received_at DESC, t.id DESC) AS rn
       FROM c JOIN t ON t.session_id = c.session_id AND c.session_id <> '' AND t.occurred_at <= c.occurred_at AND t.occurred_at >= c.occurred_at - INTERVAL {L} DAY),
 lt AS (SELECT c.*, coalesce(u.touch_id, s.touch_id) AS touch_id,
          CASE WHEN u.touch_id IS NOT NULL THEN 'user' WHEN s.touch_id IS NOT NULL THEN 'session' END AS tier
        FROM c LEFT JOIN u ON u.conv_id = c.id AND u.rn = 1 LEFT JOIN s ON s.conv_id = c.id AND s.rn = 1)"""

# A2 in SQL: channel inference + two min(id) lookups
CH = """coalesce(CASE WHEN nullif({p}gclid, '') IS NOT NULL THEN 'google'
              WHEN nullif({p}fbclid, '') IS NOT NULL OR nullif({p}fbc, '') IS NOT NULL THEN 'meta' END,
         CASE WHEN {p}utm_source IS NULL OR {p}utm_source = '' THEN NULL
              WHEN lower({p}utm_source) LIKE '%google%' OR lower({p}utm_source) LIKE '%youtube%' OR lower({p}utm_source) LIKE '%gdn%' OR lower({p}utm_source) LIKE '%adwords%' THEN 'google'
              WHEN lower({p}utm_source) LIKE '%facebook%' OR lower({p}utm_source) LIKE '%meta%' OR lower({p}utm_source) LIKE '%instagram%' OR lower({p}utm_source) LIKE '%fb%' OR lower({p}utm_source) LIKE '%ig%' THEN 'meta' END)"""
MAP_CTES = f"""by_name AS (SELECT channel, lower(name) AS name_key, min(id) AS by_name_id FROM ad_entity WHERE app = '{APP}' AND name IS NOT NULL GROUP BY 1, 2),
 by_parsed AS (SELECT channel, city, category, min(id) AS by_parsed_id FROM ad_entity WHERE app = '{APP}' AND city IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2, 3)"""


def map_sql(src: str, p: str = "") -> str:
    """SELECT over ``src`` adding mapped_entity_id / mapped_channel."""
    parts = f"list_transform(string_split({p}utm_campaign, '_'), lambda x: lower(trim(x)))"
    return f"""(SELECT m.*, coalesce(bn.by_name_id, bp.by_parsed_id) AS mapped_entity_id,
        CASE WHEN coalesce(bn.by_name_id, bp.by_parsed_id) IS NOT NULL THEN m._ch END AS mapped_channel
      FROM (SELECT s.*, CASE WHEN usable THEN ch END AS _ch, CASE WHEN usable THEN lower({p}utm_campaign) END AS _name_key,
                   CASE WHEN usable AND len(parts) >= 3 AND nullif(parts[1], '') IS NOT NULL AND nullif(parts[2], '') IS NOT NULL
                             AND nullif(parts[3], '') IS NOT NULL THEN parts[1] END AS _pcity,
                   CASE WHEN usable AND len(parts) >= 3 AND nullif(parts[1], '') IS NOT NULL AND nullif(parts[2], '') IS NOT NULL
                             AND nullif(parts[3], '') IS NOT NULL THEN parts[2] END AS _pcat
            FROM (SELECT x.*, {CH.format(p=p)} AS ch, {parts} AS parts,
                         ({CH.format(p=p)}) IS NOT NULL AND {p}utm_campaign IS NOT NULL AND {p}utm_campaign <> '' AS usable
                  FROM {src} x) s) m
      LEFT JOIN by_name bn ON bn.channel = m._ch AND bn.name_key = m._name_key
      LEFT JOIN by_parsed bp ON bp.channel = m._ch AND bp.city = m._pcity AND bp.category = m._pcat)"""


@register("last_touch", f"""WITH {LAST_TOUCH_CTES}
SELECT lt.id AS conv_id, lt.order_id, lt.touch_id, lt.tier FROM lt
""", ("conversion", "attribution_touch"))
def last_touch(t):
    lt = at.last_touch(t.conversion, t.attribution_touch, APP, LOOKBACK_DAYS)
    return lt.select(F.col("id").alias("conv_id"), "order_id", F.col("touch.id").alias("touch_id"), "tier")


@register("last_touch_single_window", f"""WITH {LAST_TOUCH_CTES}
SELECT lt.id AS conv_id, lt.order_id, lt.touch_id, lt.tier FROM lt
""", ("conversion", "attribution_touch"))
def last_touch_single_window(t):
    """A1 by one window a key, unless a key has too many rows for a task: then by the form
    that splits it."""
    mode = choose_mode([(df, ["user_id", "session_id"], "occurred_at") for df in (t.conversion, t.attribution_touch)], LOOKBACK_DAYS, small_bytes=0)
    lt = at.last_touch(t.conversion, t.attribution_touch, APP, LOOKBACK_DAYS, mode=mode)
    return lt.select(F.col("id").alias("conv_id"), "order_id", F.col("touch.id").alias("touch_id"), "tier")


@register("last_touch_replicated", f"""WITH {LAST_TOUCH_CTES}
SELECT lt.id AS conv_id, lt.order_id, lt.touch_id, lt.tier FROM lt
""", ("conversion", "attribution_touch"))
def last_touch_replicated(t):
    """A1 on the form of time buckets, each touch copied into the two that it can serve."""
    lt = at.last_touch(t.conversion, t.attribution_touch, APP, LOOKBACK_DAYS, mode="replicate")
    return lt.select(F.col("id").alias("conv_id"), "order_id", F.col("touch.id").alias("touch_id"), "tier")


@register("last_touch_carried", f"""WITH {LAST_TOUCH_CTES}
SELECT lt.id AS conv_id, lt.order_id, lt.touch_id, lt.tier FROM lt
""", ("conversion", "attribution_touch"))
def last_touch_carried(t):
    """A1 on the carried-bucket form of the kernel (1-day buckets)."""
    from ..operators.asof import asof_last
    conv = t.conversion.where(F.col("app") == APP)
    tt = at._with_touch_cols(t.attribution_touch.where(F.col("app") == APP))
    common = dict(target_ts="occurred_at", target_id="id", source_ts="occurred_at",
                  source_tiebreak=["received_at", "id"], source_cols=["utm_campaign"],
                  lookback_days=LOOKBACK_DAYS, bucket_hours=24, carry=True)
    u = asof_last(conv, tt, target_key="user_id", source_key="user_id", out="_u", **common)
    sess = F.when(F.col("_u").isNull(), F.nullif(F.col("session_id"), F.lit("")))
    s = asof_last(u, tt, target_key=sess, source_key=F.nullif(F.col("session_id"), F.lit("")), out="_s", **common)
    return s.select(F.col("id").alias("conv_id"), "order_id", F.coalesce("_u.id", "_s.id").alias("touch_id"),
                    F.when(F.col("_u").isNotNull(), "user").when(F.col("_s").isNotNull(), "session").alias("tier"))


@register("last_touch_range", f"""WITH {LAST_TOUCH_CTES}
SELECT lt.id AS conv_id, lt.order_id, lt.touch_id, lt.tier FROM lt
""", ("conversion", "attribution_touch"))
def last_touch_range(t):
    """A1 on the range-partitioned form of the kernel (skew-proof)."""
    lt = at.last_touch(t.conversion, t.attribution_touch, APP, LOOKBACK_DAYS, mode="range")
    return lt.select(F.col("id").alias("conv_id"), "order_id", F.col("touch.id").alias("touch_id"), "tier")


@register("map_touch_to_entity", f"""WITH {MAP_CTES}
SELECT id AS touch_id, mapped_entity_id, mapped_channel
FROM {map_sql(f"(SELECT * FROM attribution_touch WHERE app = '{APP}')")} q
""", ("attribution_touch", "ad_entity"))
def map_touch_to_entity(t):
    touches = at._with_touch_cols(t.attribution_touch.where(F.col("app") == APP))
    m = at.map_touch_to_entity(touches, t.ad_entity, APP, touch=None)
    return m.select(F.col("id").alias("touch_id"), F.col("mapped_entity_id").cast("bigint").alias("mapped_entity_id"),
                    "mapped_channel")


RESOLVE_SQL_CTES = f"""{LAST_TOUCH_CTES}, {MAP_CTES},
 lt2 AS (SELECT lt.*, tt.gclid AS t_gclid, tt.fbclid AS t_fbclid, tt.fbc AS t_fbc, tt.utm_source AS t_utm_source,
                tt.utm_campaign AS t_utm_campaign FROM lt LEFT JOIN t tt ON tt.id = lt.touch_id),
 mapped AS {map_sql("lt2", "t_")},
 resolved AS (SELECT mapped.*, CAST(mapped_entity_id AS BIGINT) AS attributed_entity_id, mapped_channel AS attributed_channel,
       CASE WHEN touch_id IS NULL THEN 'no_touch' WHEN mapped_entity_id IS NOT NULL THEN 'matched' ELSE 'organic' END AS attribution_outcome
     FROM mapped)"""


@register("resolve_attribution", f"""WITH {RESOLVE_SQL_CTES}
SELECT app, order_id, attributed_entity_id, attributed_channel, 'last_touch' AS attribution_model,
       attribution_outcome, touch_id AS attributed_touch_id FROM resolved
""", ("conversion", "attribution_touch", "ad_entity"))
def resolve_attribution(t):
    r = at.resolve_attribution(t.conversion, t.attribution_touch, t.ad_entity, APP, LOOKBACK_DAYS, resolved_at=NOW)
    return r.select("app", "order_id", "attributed_entity_id", "attributed_channel", "attribution_model",
                    "attribution_outcome", "attributed_touch_id")


@register("resolve_attribution_incremental", f"""WITH {RESOLVE_SQL_CTES}
SELECT app, order_id, attribution_outcome FROM resolved WHERE id % 3 = 0
""", ("conversion", "attribution_touch", "ad_entity"))
def resolve_attribution_incremental(t):
    """A3 idempotence: conversions resolved earlier (id % 3 <> 0) are skipped."""
    done = t.conversion.where(F.col("id") % 3 != 0).select("app", "order_id")
    r = at.resolve_attribution(t.conversion, t.attribution_touch, t.ad_entity, APP, LOOKBACK_DAYS,
                               already_resolved=done, resolved_at=NOW)
    return r.select("app", "order_id", "attribution_outcome")
