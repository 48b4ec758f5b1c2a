"""Registered segment queries (G1–G20). The oracle keeps each user's orders and
events as lists and tests the definition on them row by row."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import segments as sg
from .params import APP, NOW
from .registry import register

NOW_SQL = f"TIMESTAMP '{NOW}'"


# ---------------------------------------------------------------------------
# oracle: a row per user with its orders and events as lists, and a predicate
# ---------------------------------------------------------------------------

HISTORY_SQL = f"""purchases AS (SELECT user_id, list({{'at': occurred_at, 'inr': value_inr, 'city': city, 'category': category}}) AS bought
  FROM conversion WHERE app = '{APP}' AND user_id IS NOT NULL GROUP BY user_id),
 doings AS (SELECT user_id, list({{'what': event_name, 'at': occurred_at, 'props': props}}) AS did
  FROM app_event WHERE app = '{APP}' AND user_id IS NOT NULL GROUP BY user_id),
 worth AS (SELECT user_id, ntile(100) OVER (ORDER BY list_sum(list_transform(bought, lambda x: x.inr)), user_id) AS place FROM purchases),
 people AS (SELECT user_id, coalesce(bought, []) AS bought, coalesce(did, []) AS did, coalesce(place, 0) AS place
  FROM purchases FULL JOIN doings USING (user_id) LEFT JOIN worth USING (user_id))"""
COMPARED = {"gte": ">=", "lte": "<=", "eq": "=", "gt": ">"}


def _text(v):
    return "'" + str(v).replace("'", "''") + "'"


def _ago(days):
    return f"({NOW_SQL} - INTERVAL {int(days)} DAY)"


def _bought(leaf):
    days = leaf.get("window_days")
    return f"list_filter(bought, lambda x: x.at >= {_ago(days)})" if days else "bought"


def _age(leaf):
    # recency looks at the newest order, age at the first; "lte" means at most so many days ago
    pick = "list_max" if leaf["kind"] == "order_recency" else "list_min"
    return f"{pick}(list_transform(bought, lambda x: x.at)) {'>=' if leaf['op'] == 'lte' else '<'} {_ago(leaf['days'])}"


def _count(leaf):
    n = f"len({_bought(leaf)})"
    return f"{n} > 0 AND {n} {COMPARED[leaf['op']]} {leaf['count']}"


def _money(leaf):
    fold = {"total": "list_sum", "avg": "list_avg"}[leaf["metric"]]
    return f"{fold}(list_transform({_bought(leaf)}, lambda x: x.inr)) {COMPARED[leaf['op']]} {leaf['value_inr']}"


def _percentile(leaf):
    return f"place > {leaf['percentile']}"


def _trait(leaf):
    wanted = leaf["value"] if isinstance(leaf["value"], list) else [leaf["value"]]
    has = f"len(list_filter(bought, lambda x: x.{leaf['field']} IN ({', '.join(map(_text, wanted))}))) > 0"
    return f"NOT ({has})" if leaf["op"] == "neq" else has


def _prop(p):
    found, v = f"json_extract_string(x.props, '$.{p['path']}')", p["value"]
    return {"eq": lambda: f"{found} = {_text(sg.prop_text(v))}", "neq": lambda: f"{found} IS DISTINCT FROM {_text(sg.prop_text(v))}",
            "gte": lambda: f"TRY_CAST({found} AS DOUBLE) >= {float(v)}", "lte": lambda: f"TRY_CAST({found} AS DOUBLE) <= {float(v)}",
            "contains": lambda: f"{found} ILIKE {_text('%' + str(v) + '%')}"}[p["op"]]()


def _doing(leaf):
    tests = [f"x.what = {_text(leaf['event'])}", f"x.at >= {_ago(leaf['window_days'])}", *map(_prop, leaf.get("props") or [])]
    done = f"len(list_filter(did, lambda x: coalesce({' AND '.join(tests)}, false))) >= {leaf.get('min_count') or 1}"
    return done if leaf["performed"] else f"NOT ({done})"


TESTS = {"order_recency": _age, "first_order_age": _age, "order_frequency": _count, "monetary": _money,
         "ltv_percentile": _percentile, "attribute": _trait, "event": _doing}


def _test(node):
    if "criteria" in node:
        return "(" + f" {node['op']} ".join(map(_test, node["criteria"])) + ")"
    return f"coalesce({TESTS[node['kind']](node)}, false)"


def membership_sql(definition, now=NOW):
    test = _test(sg.validate(definition)["group"]).replace(NOW_SQL, f"TIMESTAMP '{now}'")
    return f"WITH {HISTORY_SQL} SELECT user_id FROM people WHERE {test}"


# ---------------------------------------------------------------------------
# fixed segment definitions
# ---------------------------------------------------------------------------

def _def(*criteria, op="AND"):
    return {"version": 1, "group": {"op": op, "criteria": list(criteria)}}


# The six system segments (event names el_* / charged).
SEED_SEGMENTS = [
    ("new_users_7d", "New users (first order ≤ 7d)", 360, _def({"kind": "first_order_age", "op": "lte", "days": 7})),
    ("dormant_30d", "Dormant 30d", 360, _def({"kind": "order_frequency", "op": "gte", "count": 1},
                                             {"kind": "order_recency", "op": "gt", "days": 30})),
    ("dormant_90d", "Dormant 90d", 720, _def({"kind": "order_frequency", "op": "gte", "count": 1},
                                             {"kind": "order_recency", "op": "gt", "days": 90})),
    ("repeat_buyers", "Repeat buyers", 360, _def({"kind": "order_frequency", "op": "gte", "count": 2})),
    ("high_value", "High value (top 10% LTV)", 720, _def({"kind": "ltv_percentile", "op": "gte", "percentile": 90})),
    ("cart_abandoners_48h", "Cart abandoners (48h)", 180,
     _def({"kind": "event", "event": "el_add_to_cart", "performed": True, "window_days": 2},
          {"kind": "event", "event": "charged", "performed": False, "window_days": 2})),
]
# last refresh per seed (None = never); with NOW = 2024-01-31 00:00 ids 2 and 6 are not due
LAST_REFRESH = {2: "2024-01-30 20:00:00", 4: "2024-01-30 10:00:00", 6: "2024-01-30 23:00:00"}

SEG_DEFS = {
    "seg_recency": _def({"kind": "order_recency", "op": "gt", "days": 5}),
    "seg_recency_lte": _def({"kind": "order_recency", "op": "lte", "days": 3}),
    "seg_first_order_age": _def({"kind": "first_order_age", "op": "lte", "days": 25}),
    "seg_frequency": _def({"kind": "order_frequency", "op": "gte", "count": 3, "window_days": 14}),
    "seg_frequency_eq": _def({"kind": "order_frequency", "op": "eq", "count": 12}),
    "seg_monetary": _def({"kind": "monetary", "metric": "avg", "op": "gte", "value_inr": 50, "window_days": 20}),
    "seg_monetary_total": _def({"kind": "monetary", "metric": "total", "op": "lte", "value_inr": 300}),
    "seg_ltv_percentile": _def({"kind": "ltv_percentile", "op": "gte", "percentile": 90}),
    "seg_attribute": _def({"kind": "attribute", "field": "city", "op": "in", "value": ["asia", "africa"]}),
    "seg_attribute_neq": _def({"kind": "attribute", "field": "category", "op": "neq", "value": "cat0"}),
    "seg_event": _def({"kind": "event", "event": "el_add_to_cart", "performed": True, "window_days": 7,
                       "min_count": 2}),
    "seg_event_not": _def({"kind": "event", "event": "charged", "performed": False, "window_days": 3}),
    "seg_event_props": _def({"kind": "event", "event": "el_signup", "performed": True, "window_days": 30,
                             "props": [{"path": "k", "op": "gte", "value": 50},
                                       {"path": "k", "op": "neq", "value": 77}]}),
    "seg_event_props_text": _def({"kind": "event", "event": "el_first_open", "performed": True, "window_days": 30,
                                  "props": [{"path": "k", "op": "contains", "value": "1"},
                                            {"path": "k", "op": "eq", "value": 11.0}]}, op="OR"),
    "seg_nested": _def(
        {"op": "OR", "criteria": [
            {"kind": "order_recency", "op": "lte", "days": 10},
            {"op": "AND", "criteria": [{"kind": "monetary", "metric": "avg", "op": "gte", "value_inr": 40},
                                       {"kind": "attribute", "field": "city", "op": "neq", "value": "asia"}]}]},
        {"kind": "event", "event": "charged", "performed": False, "window_days": 5}),
}


def _segments_df(spark):
    rows = []
    for i, (slug, name, interval, d) in enumerate(SEED_SEGMENTS, start=1):
        rows.append((i, APP, slug, name, json.dumps(d), interval, "active", True, LAST_REFRESH.get(i)))
    rows.append((7, APP, "paused_custom", "Custom (paused)", json.dumps(SEG_DEFS["seg_nested"]), 60, "paused", False, None))
    rows.append((8, APP, "custom_nested", "Custom nested", json.dumps(SEG_DEFS["seg_nested"]), 60, "active", False, None))
    df = spark.createDataFrame(rows, "id long, app string, slug string, name string, definition string, "
                                     "refresh_interval_minutes int, status string, is_system boolean, last_refreshed_at string")
    return df.withColumn("last_refreshed_at", F.col("last_refreshed_at").cast("timestamp_ntz"))


for _name, _d in SEG_DEFS.items():
    def _mk(d):
        return lambda t: sg.membership(d, t.conversion, t.app_event, APP, NOW)
    register(_name, membership_sql(_d), ("conversion", "app_event"))(_mk(_d))


# days on which the seeds of new and of dormant users have members: orders run through January 2024
SEED_NOW = {"new_users_7d": "2024-01-06 00:00:00", "dormant_30d": "2024-02-27 00:00:00", "dormant_90d": "2024-04-27 00:00:00"}


for _slug, _n, _i, _d in SEED_SEGMENTS:
    def _mk2(d, now):
        return lambda t: sg.membership(d, t.conversion, t.app_event, APP, now)
    _at = SEED_NOW.get(_slug, NOW)
    register(f"seg_seed_{_slug}", membership_sql(_d, _at), ("conversion", "app_event"))(_mk2(_d, _at))


@register("seg_dry_run", f"""
WITH m AS ({membership_sql(SEG_DEFS['seg_nested'])})
SELECT CAST((SELECT count(*) FROM m) AS INT) AS count, coalesce((SELECT list(user_id ORDER BY user_id) FROM (SELECT user_id FROM m ORDER BY user_id LIMIT 10)), CAST([] AS BIGINT[])) AS sample_user_ids
""", ("conversion", "app_event"))
def seg_dry_run(t):
    return sg.dry_run(SEG_DEFS["seg_nested"], t.conversion, t.app_event, APP, NOW)


def _due_rows(spark):
    """Segment metadata of the due segments (a handful of rows)."""
    return [r.asDict() for r in sg.due_segments(_segments_df(spark), NOW).collect()]


def _refresh(t):
    return sg.refresh_segments(_due_rows(t.spark), t.conversion, t.app_event, APP, NOW)


def _due_ids():
    out = []
    for i, (slug, name, interval, d) in enumerate(SEED_SEGMENTS, start=1):
        import datetime as dt
        lr = LAST_REFRESH.get(i)
        now = dt.datetime.fromisoformat(NOW)
        if lr is None or dt.datetime.fromisoformat(lr) + dt.timedelta(minutes=interval) < now:
            out.append((i, d))
    out.append((8, SEG_DEFS["seg_nested"]))
    return out


DUE_SQL = ", ".join(f"({i})" for i, _d in _due_ids())
REFRESH_SQL = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS segment_id, user_id FROM ({membership_sql(d)}) m{i}"
                                 for i, d in _due_ids())


@register("segments_refresh", REFRESH_SQL, ("conversion", "app_event"))
def segments_refresh(t):
    return _refresh(t).select("segment_id", "user_id")


@register("segments_refresh_summary", f"""
SELECT CAST(d.id AS BIGINT) AS id, CAST(count(r.segment_id) AS INT) AS last_count
FROM (VALUES {DUE_SQL}) d(id) LEFT JOIN ({REFRESH_SQL}) r ON r.segment_id = d.id GROUP BY 1
""", ("conversion", "app_event"))
def segments_refresh_summary(t):
    due = sg.due_segments(_segments_df(t.spark), NOW)
    return sg.refresh_bookkeeping(due, _refresh(t), NOW).select("id", "last_count")


@register("segments_due", f"""
SELECT CAST(d.id AS BIGINT) AS id, CAST(count(r.segment_id) AS INT) AS members
FROM (VALUES {DUE_SQL}) d(id) LEFT JOIN ({REFRESH_SQL}) r ON r.segment_id = d.id GROUP BY 1
""", ("conversion", "app_event"))
def segments_due(t):
    """G17 joined with the refreshed member counts of the due segments."""
    due = sg.due_segments(_segments_df(t.spark), NOW).select("id")
    counts = _refresh(t).groupBy("segment_id").agg(F.count(F.lit(1)).cast("int").alias("members"))
    return due.join(counts, due["id"] == counts["segment_id"], "left").select("id", F.coalesce("members", F.lit(0)).alias("members"))


@register("seg_members_page", f"""
WITH m AS (SELECT user_id FROM ({REFRESH_SQL}) r WHERE segment_id = 8),
 p AS (SELECT user_id FROM m WHERE user_id > 20 ORDER BY user_id LIMIT 25)
SELECT CAST(8 AS BIGINT) AS segment_id, coalesce((SELECT list(user_id ORDER BY user_id) FROM p), CAST([] AS BIGINT[])) AS user_ids,
  CASE WHEN (SELECT count(*) FROM p) = 25 THEN (SELECT max(user_id) FROM p) END AS next_cursor,
  CAST((SELECT count(*) FROM m) AS INT) AS total
""", ("conversion", "app_event"))
def seg_members_page(t):
    return sg.segment_members(_refresh(t), 8, 20, 25)


@register("segments_list", f"""
WITH counts AS (SELECT segment_id, CAST(count(*) AS INT) AS c FROM ({REFRESH_SQL}) r GROUP BY 1)
SELECT CAST(s.id AS BIGINT) AS id, s.slug, coalesce(counts.c, 0) AS last_count FROM (VALUES {', '.join(f"({i}, '{slug}')" for i, (slug, *_r) in enumerate(SEED_SEGMENTS, start=1))}, (8, 'custom_nested')) s(id, slug)
LEFT JOIN counts ON counts.segment_id = s.id
""", ("conversion", "app_event"))
def segments_list(t):
    """G19 (active segments, system first, then name) with the member counts
    of this refresh."""
    segs = sg.list_segments(_segments_df(t.spark), APP, status="active")
    counts = _refresh(t).groupBy("segment_id").agg(F.count(F.lit(1)).cast("int").alias("c"))
    return (segs.join(counts, segs["id"] == counts["segment_id"], "left")
            .select("id", "slug", F.coalesce("c", F.lit(0)).alias("last_count")))


@register("segments_archive", f"""
SELECT segment_id, user_id FROM ({REFRESH_SQL}) r WHERE segment_id NOT IN (1, 8)
""", ("conversion", "app_event"))
def segments_archive(t):
    """Archiving segments 1 and 8 drops their membership rows."""
    _segs, members = sg.archive_segments(_segments_df(t.spark), _refresh(t), [1, 8])
    return members.select("segment_id", "user_id")
