"""Exact-value seed cases carried over from the reference's tests (as small
DataFrames), one per operator family."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from conftest import mk, ts
from touchline.operators import alerts as al
from touchline.operators import attribution as at
from touchline.operators import brand as br
from touchline.operators import events as ev
from touchline.operators import ingest as ig
from touchline.operators import metrics as mt
from touchline.operators import monitor as mo
from touchline.operators import outbox as ob
from touchline.operators import segments as sg
from touchline.functions.columns import parse_campaign_name
from touchline.functions.text import extract_domains

APP = "services"

ENTITY_SCHEMA = ("id long, app string, channel string, level string, external_id string, parent_external_id string, "
                 "name string, city string, category string")
PERF_SCHEMA = ("app string, ad_entity_id long, stat_date date, channel string, spend_inr decimal(14,2), "
               "impressions long, clicks long, conversions decimal(14,2), conv_value_inr decimal(14,2)")
TOUCH_SCHEMA = ("id long, app string, occurred_at timestamp_ntz, received_at timestamp_ntz, channel string, "
                "gclid string, fbclid string, fbc string, fbp string, utm_source string, utm_campaign string, "
                "touch_type string, session_id string, user_id long")
CONV_SCHEMA = ("id long, app string, order_id string, user_id long, occurred_at timestamp_ntz, value_inr decimal(10,2), "
               "is_first_order boolean, city string, category string, session_id string")


def d(s):
    return dt.date.fromisoformat(s)


def test_last_touch_cac_and_cost_per_first_order(spark):
    ent = mk(spark, [(1, APP, "meta", "campaign", "c1", None, "mumbai_homecleaning_purchase", "mumbai",
                                  "homecleaning")], ENTITY_SCHEMA)
    perf = mk(spark, [(APP, 1, d("2026-06-20"), "meta", 3000, 5000, 200, 10, 8000)], PERF_SCHEMA)
    touch = mk(spark, [(1, APP, ts("2026-06-20 09:00:00"), ts("2026-06-20 09:00:00"), None, None, None,
                                    None, None, "facebook", "mumbai_homecleaning_purchase", "touch", "s1", 42)],
                                  TOUCH_SCHEMA)
    conv = mk(spark, [(1, APP, "O1", 42, ts("2026-06-20 10:00:00"), 1500, True, None, None, None)],
                                 CONV_SCHEMA)
    res = at.resolve_attribution(conv, touch, ent, APP, 7)
    r = res.collect()[0]
    assert r.attribution_outcome == "matched" and r.attributed_entity_id == 1 and r.attributed_channel == "meta"
    cac = mt.cac_summary(perf, ent, conv, APP, "2026-06-01", "2026-06-30").collect()[0]
    assert (cac.first_orders, cac.spend_inr, cac.blended_cac_inr) == (1.0, 3000.0, 3000.0)
    cp = mt.cost_per_first_order(perf, ent, res, APP, "2026-06-01", "2026-06-30").collect()[0]
    assert cp.campaign == "mumbai_homecleaning_purchase" and cp.first_orders == 1 and cp.cost_per_first_order_inr == 3000


def _ltv_seed(spark):
    ent = mk(spark, [(1, APP, "meta", "campaign", "c1", None, "bangalore_homecleaning_purchase",
                                  "bangalore", "homecleaning")], ENTITY_SCHEMA)
    perf = mk(spark, [(APP, 1, d("2026-06-05"), "meta", 1000, 0, 0, 0, 0)], PERF_SCHEMA)
    rows = [(1, APP, "O1", 1, ts("2026-06-05 10:00:00"), 1000, True, "bangalore", "homecleaning", "s1", "meta", 1),
            (2, APP, "O2", 1, ts("2026-06-15 10:00:00"), 500, False, "bangalore", "homecleaning", "s1", None, None),
            (3, APP, "O3", 2, ts("2026-06-10 10:00:00"), 2000, True, "bangalore", "homecleaning", None, "meta", 1)]
    conv = mk(spark, rows, CONV_SCHEMA + ", attributed_channel string, attributed_entity_id long")
    return ent, perf, conv


def test_repeat_rate_cohort_and_ltv_cac(spark):
    ent, perf, conv = _ltv_seed(spark)
    f = ("2026-06-01", "2026-06-30")
    r = mt.repeat_rate(conv, APP, *f).collect()[0]
    assert (r.customers, r.repeat_customers, r.repeat_rate, r.avg_orders_per_customer,
            r.avg_revenue_per_customer_inr) == (2, 1, 0.5, 1.5, 1750)
    meta = [x for x in mt.cohort_revenue(conv, ent, APP, *f).collect() if x.channel == "meta"][0]
    assert (meta.customers, meta.cumulative_revenue_inr, meta.ltv_per_customer_inr) == (2, 3500, 1750)
    lc = [x for x in mt.ltv_cac(conv, perf, ent, APP, *f).collect() if x.channel == "meta"][0]
    assert (lc.spend_inr, lc.acquired_customers, lc.cohort_revenue_inr, lc.cac_inr, lc.ltv_cac_ratio) == \
        (1000, 2, 3500, 500, 3.5)


EVENT_SCHEMA = "event_id string, app string, event_name string, occurred_at timestamp_ntz, session_id string, user_id long"
LINK_SCHEMA = "app string, session_id string, user_id long"


def test_funnel_retention_and_dau(spark):
    day = "2026-06-10"
    e = []
    n = 0

    def add(name, t, sess, user):
        nonlocal n
        n += 1
        e.append((str(n), APP, name, ts(t), sess, user))
    # three users walk a 3-step journey; user 3 does step 3 before step 2
    for u in (1, 2, 3):
        add("el_first_open", f"{day} 09:00:00", f"s{u}", u)
        add("el_signup", f"{day} 09:10:00", f"s{u}", u)
    add("el_add_to_cart", f"{day} 09:20:00", "s1", 1)
    add("el_add_to_cart", f"{day} 09:05:00", "s3", 3)
    events = mk(spark, e, EVENT_SCHEMA)
    links = mk(spark, [], LINK_SCHEMA)
    out = ev.ordered_funnel(events, links, APP, day, day, ["el_first_open", "el_signup", "el_add_to_cart"]).collect()
    assert [r.users for r in out] == [3, 3, 1]
    assert out[2].pct_of_first == 33.33 and out[0].pct_of_prev == 100.0

    # cohort of 2, one comes back the next (business-zone) day
    r = [("a", APP, "el_first_open", ts("2026-06-10 06:00:00"), "x", 10),
         ("b", APP, "el_first_open", ts("2026-06-10 06:00:00"), "y", 11),
         ("c", APP, "el_first_open", ts("2026-06-11 06:00:00"), "x", 10)]
    ret = ev.retention(mk(spark, r, EVENT_SCHEMA), links, APP, "2026-06-10", "2026-06-11", (1,)).collect()
    first = [x for x in ret if x.cohort_date == "2026-06-10"][0]
    assert (first.size, first.d1, first.rate_d1) == (2, 1, 50.0)

    # anonymous + logged-in (stitched) + another anonymous on the same day
    r = [("1", APP, "el_first_open", ts("2026-06-10 08:00:00"), "anon1", None),
         ("2", APP, "el_signup", ts("2026-06-10 08:05:00"), "anon1", 7),
         ("3", APP, "el_first_open", ts("2026-06-10 09:00:00"), "anon2", None)]
    lk = mk(spark, [(APP, "anon1", 7)], LINK_SCHEMA)
    dau = ev.dau_daily(mk(spark, r, EVENT_SCHEMA), lk, APP, "2026-06-10", "2026-06-10").collect()[0]
    assert (dau.dau, dau.events) == (2, 3)


def test_session_linked_to_two_users_fans_out(spark):
    r = [("1", APP, "el_first_open", ts("2026-06-10 08:00:00"), "shared", None)]
    lk = mk(spark, [(APP, "shared", 1), (APP, "shared", 2)], LINK_SCHEMA)
    dau = ev.dau_daily(mk(spark, r, EVENT_SCHEMA), lk, APP, "2026-06-10", "2026-06-10").collect()[0]
    assert (dau.dau, dau.events) == (2, 2)   # kept on purpose (SURVEY X2)


def test_segments_dormant_and_cart_abandoners(spark):
    now = "2026-07-01 00:00:00"
    conv = mk(spark, 
        [(1, APP, "o1", 10, ts("2026-05-17 00:00:00"), 100, True, None, None, None),
         (2, APP, "o2", 11, ts("2026-06-26 00:00:00"), 100, True, None, None, None)], CONV_SCHEMA)
    events = mk(spark, 
        [("e1", APP, "el_add_to_cart", ts("2026-06-30 10:00:00"), "s20", 20),
         ("e2", APP, "el_add_to_cart", ts("2026-06-30 10:00:00"), "s21", 21),
         ("e3", APP, "charged", ts("2026-06-30 11:00:00"), "s21", 21)], EVENT_SCHEMA + ", props string"
        .replace(", props string", "")).withColumn("props", F.lit(None).cast("string"))
    dormant = {"version": 1, "group": {"op": "AND", "criteria": [
        {"kind": "order_frequency", "op": "gte", "count": 1}, {"kind": "order_recency", "op": "gt", "days": 30}]}}
    assert [r.user_id for r in sg.membership(dormant, conv, events, APP, now).collect()] == [10]
    cart = {"version": 1, "group": {"op": "AND", "criteria": [
        {"kind": "event", "event": "el_add_to_cart", "performed": True, "window_days": 2},
        {"kind": "event", "event": "charged", "performed": False, "window_days": 2}]}}
    assert [r.user_id for r in sg.membership(cart, conv, events, APP, now).collect()] == [20]


def test_segment_paging_ends_with_empty_page(spark):
    members = mk(spark, [(1, u, ts("2026-07-01 00:00:00")) for u in (3, 5, 9)],
                                    "segment_id long, user_id long, computed_at timestamp_ntz")
    p1 = sg.segment_members(members, 1, None, 2).collect()[0]
    assert p1.user_ids == [3, 5] and p1.next_cursor == 5 and p1.total == 3
    p2 = sg.segment_members(members, 1, 5, 2).collect()[0]
    assert p2.user_ids == [9] and p2.next_cursor is None
    p3 = sg.segment_members(members, 1, 9, 2).collect()[0]
    assert p3.user_ids == [] and p3.next_cursor is None


def test_definition_bounds():
    import pytest
    leaf = {"kind": "order_frequency", "op": "gte", "count": 1}
    deep = {"version": 1, "group": {"op": "AND", "criteria": [{"op": "OR", "criteria": [
        {"op": "AND", "criteria": [{"op": "OR", "criteria": [leaf]}]}]}]}}
    with pytest.raises(sg.DefinitionError):
        sg.validate(deep)
    with pytest.raises(sg.DefinitionError):
        sg.validate({"version": 1, "group": {"op": "AND", "criteria": [leaf] * 21}})
    with pytest.raises(sg.DefinitionError):
        sg.validate({"version": 1, "group": {"op": "AND", "criteria": [
            {"kind": "event", "event": "Bad-Name", "performed": True, "window_days": 1}]}})
    assert sg.validate({"version": 1, "group": {"op": "OR", "criteria": [leaf] * 20}})


def test_monitor_grades(spark):
    now = "2026-07-04 12:00:00"
    events = mk(spark, 
        [("1", APP, "el_home_view", ts("2026-07-04 11:00:00"), None, None),
         ("2", APP, "el_checkout", ts("2026-07-04 09:00:00"), None, None)], EVENT_SCHEMA)
    touches = mk(spark, 
        [(1, APP, ts("2026-07-04 10:00:00"), ts("2026-07-04 10:00:00"), None, None, None, None, None, None, None,
          "first_party_click", "s", None),
         (2, APP, ts("2026-07-04 10:00:00"), ts("2026-07-04 10:00:00"), None, None, None, None, None, None, None,
          "touch", "s", None)], TOUCH_SCHEMA)
    leads = mk(spark, [(1, APP, ts("2026-07-04 10:00:00"))], "id long, app string, occurred_at timestamp_ntz")
    conv = mk(spark, [(1, APP, "o", 1, ts("2026-07-04 10:00:00"), 1, True, None, None, None)], CONV_SCHEMA)
    reg = mk(spark, 
        [(1, APP, "app", "el_home_view", "hourly", True), (2, APP, "app", "el_checkout", "hourly", True),
         (3, APP, "conversion", "", "daily", False), (4, APP, "app", "el_ghost", "daily", True),
         (5, APP, "app", "", "daily", True), (6, APP, "click", "", "daily", True)],
        "id int, app string, source string, event_name string, expected_frequency string, is_active boolean")
    rows = {(r.source, r.event_name): r for r in mo.streams_overview(events, touches, leads, conv, reg, APP, now).collect()}
    assert rows[("app", "el_home_view")].health == "ok" and rows[("app", "el_home_view")].count_24h == 1
    assert rows[("app", "el_checkout")].health == "stale"
    g = rows[("app", "el_ghost")]
    assert (g.count_24h, g.count_7d, g.last_seen, g.health) == (0, 0, None, "stale")
    w = rows[("app", None)]
    assert (w.count_24h, w.count_7d, w.health) == (2, 2, "ok") and w.last_seen == ts("2026-07-04 11:00:00")
    assert rows[("click", None)].health == "ok"
    assert rows[("conversion", None)].health == "muted"
    assert rows[("touch", None)].health == "unregistered" and rows[("lead", None)].health == "unregistered"


def test_event_clamp_and_month_retention(spark):
    now = F.lit("2026-07-04 12:00:00").cast("timestamp_ntz")
    df = mk(spark, [(ts("2026-01-01 00:00:00"),), (ts("2026-08-01 00:00:00"),), (ts("2026-07-01 00:00:00"),)],
                               "t timestamp_ntz")
    got = [r.c for r in df.select(ig.clamp_occurred_at(F.col("t"), now).alias("c")).collect()]
    assert got == [ts("2026-06-04 12:00:00"), ts("2026-07-04 13:00:00"), ts("2026-07-01 00:00:00")]
    kept = ig.retained_months("2026-07-15 00:00:00", 13)
    assert "2025_07" in kept and "2025_06" not in kept and len(kept) == 15


def test_campaign_name_parsing(spark):
    df = mk(spark, [("Mumbai_Home_Cleaning_Purchase",), ("bad",), ("a__b",), (None,)], "n string")
    rows = df.select(parse_campaign_name(F.col("n")).alias("p")).collect()
    p = rows[0].p
    assert (p.city, p.category, p.objective, p.parsed_ok) == ("mumbai", "home", "cleaning", True)
    assert not rows[1].p.parsed_ok and not rows[2].p.parsed_ok and not rows[3].p.parsed_ok


def test_mention_detection(spark):
    aliases = ["acme life"]
    pos = ["I booked Acme Life yesterday", "try acmelife.in now", "ACME-LIFE is fine", "see acme.life", "acme_life",
           "(acme life)"]
    neg = ["acmelifestyle shop", "myacmelife", "acme lives", "the acme company", ""]
    df = mk(spark, [(t,) for t in pos + neg], "text string")
    got = [r.m.mentioned for r in df.select(br.detect_mention(F.col("text"), aliases).alias("m")).collect()]
    assert got == [True] * len(pos) + [False] * len(neg)
    long_text = "x" * 100 + " acme life " + "y" * 100
    ex = mk(spark, [(long_text,)], "text string").select(
        br.detect_mention(F.col("text"), aliases)["excerpt"].alias("e")).collect()[0].e
    assert ex == ("x" * 59 + " acme life " + "y" * 60).strip() or ex.startswith("x")


def test_domain_extraction(spark):
    text = "See https://www.Example.com/a, and http://foo.org/x?y=1. Also https://www.example.com/b; bare https://localhost/"
    got = mk(spark, [(text,)], "t string").select(extract_domains(F.col("t")).alias("d")).collect()[0].d
    assert got == ["example.com", "foo.org"]


def test_question_grid(spark):
    cities = mk(spark, [(f"city{i}", i) for i in range(5)], "name string, ord int")
    cats = mk(spark, [(f"cat{i}", i) for i in range(5)], "name string, ord int")
    assert br.question_grid(cities, cats, "Brand", "brand.example").count() == 2 + 2 * 5 * 5
    q = br.question_grid(cities, cats, "Brand", "brand.example", max_questions=40).collect()
    assert len(q) == 40 and q[0].key.startswith("brand|") and q[1].key.startswith("brand|")
    assert q[2].key == "best|cat0|city0" and q[2].text == "best cat0 services in city0"
    assert q[39].key == "book|cat2|city2"   # 2 probes + 25 'best' + 13 'book'


def test_alert_rules(spark):
    cpfo = mk(spark, [("camp_a", None, None, 800.0), ("camp_b", None, None, 300.0)],
                                 "campaign string, city string, category string, cost_per_first_order_inr double")
    p = al.rule_cost_high(cpfo, APP, 500).collect()
    assert len(p) == 1 and p[0].message == "Cost per first order ₹800 exceeds ₹500 for camp_a"
    rows = [(i, APP, f"o{i}", i, ts(f"2026-06-{d:02d} 10:00:00"), 1, True, None, None, None)
            for i, d in enumerate([3] + [d for d in range(20, 27) for _ in range(10)], start=1)]
    conv = mk(spark, rows[1:], CONV_SCHEMA).union(mk(spark, 
        [(900 + k, APP, f"t{k}", 900 + k, ts("2026-06-27 10:00:00"), 1, True, None, None, None) for k in range(3)],
        CONV_SCHEMA))
    drop = al.rule_first_order_drop(conv, APP, "2026-06-27").collect()
    assert len(drop) == 1 and drop[0].severity == "critical"
    assert drop[0].message == "First orders today (3) down 70% vs trailing avg (10.0)"
    healthy = conv.union(mk(spark, 
        [(950 + k, APP, f"h{k}", 950 + k, ts("2026-06-27 11:00:00"), 1, True, None, None, None) for k in range(7)],
        CONV_SCHEMA))
    assert al.rule_first_order_drop(healthy, APP, "2026-06-27").count() == 0


def test_purchase_and_lead_payloads(spark):
    rows = mk(spark, 
        [(APP, "O1", 42, ts("2026-06-20 10:00:00"), 1500, "Mumbai", "fb.1.x", "fb.1.y", None, "app"),
         (APP, "O2", None, ts("2026-06-20 10:00:00"), 10, None, None, None, "clid9", None)],
        "app string, order_id string, user_id long, occurred_at timestamp_ntz, value_inr decimal(10,2), city string, "
        "fbc string, fbp string, ctwa_clid string, action_source string")
    out = {r.event_id: r for r in ob.purchase_payload(rows).collect()}
    a = out["O1"]
    assert a.external_id_hash == hashlib.sha256(b"42").hexdigest()
    assert a.ct_hash == hashlib.sha256(b"mumbai").hexdigest()
    assert (a.fbc, a.fbp, a.action_source, a.event_time, a.value) == ("fb.1.x", "fb.1.y", "app", 1781949600, 1500.0)
    b = out["O2"]
    assert (b.action_source, b.messaging_channel, b.ctwa_clid, b.external_id_hash) == \
        ("business_messaging", "whatsapp", "clid9", None)
    assert '"external_id"' not in b.payload
    leads = mk(spark, [(APP, 1, "c1", "a" * 64, ts("2026-06-20 10:00:00"))],
                                  "app string, id long, ctwa_clid string, wa_phone_hash string, occurred_at timestamp_ntz")
    lp = ob.lead_payload(leads).collect()[0]
    assert (lp.event_id, lp.ph, lp.action_source) == ("lead-c1", "a" * 64, "business_messaging")


def test_insert_ignore_is_idempotent(spark):
    conv = mk(spark, [(1, APP, "O1", 42, ts("2026-06-20 10:00:00"), 1500, True, None, None, "s1")],
                                 CONV_SCHEMA)
    empty = conv.where(F.lit(False))
    new, flagged = ig.ingest_conversions(conv, empty)
    assert new.count() == 1 and not flagged.collect()[0].deduped
    new2, flagged2 = ig.ingest_conversions(conv, new)
    assert new2.count() == 0 and flagged2.collect()[0].deduped


def test_stitch_latest_and_approx_dau(spark):
    r = [("1", APP, "el_first_open", ts("2026-06-10 08:00:00"), "shared", None)]
    lk = mk(spark, [(APP, "shared", 1), (APP, "shared", 2)], LINK_SCHEMA)
    ev_df = mk(spark, r, EVENT_SCHEMA)
    latest = ev.dau_daily(ev_df, lk, APP, "2026-06-10", "2026-06-10", stitch="latest").collect()[0]
    assert (latest.dau, latest.events) == (1, 1)
    approx = ev.dau_daily(ev_df, lk, APP, "2026-06-10", "2026-06-10", approx=True).collect()[0]
    assert (approx.dau, approx.events) == (2, 2)
    tot = ev.dau_totals(ev_df, lk, APP, "2026-06-10", "2026-06-10", approx=True).collect()[0]
    assert (tot.unique_users, tot.events) == (2, 2)
