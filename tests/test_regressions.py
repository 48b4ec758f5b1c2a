"""Cases that once gave wrong or missing rows."""

import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import mk, ts
from touchline.functions.columns import parse_campaign_name
from touchline.functions.text import js_trim
from touchline.operators import alerts as al
from touchline.operators import ingest as ig
from touchline.operators import outbox as ob
from touchline.operators import segments as sg
from touchline.sources import sinks, tables
from touchline.streaming import ingest as st

APP = "services"
PROPOSAL = ("app string, rule_key string, severity string, campaign string, city string, category string, metric string, "
            "observed double, threshold double, message string")


def test_equal_proposals_fire_once(spark):
    rows = [(APP, "cpfo_high", "warn", "c", city, "k", "m", 1.0, 0.5, "same message") for city in ("b", "a", None)]
    old = mk(spark, [(APP, "cpfo_high", "other", ts("2026-07-01 01:00:00"))], "app string, rule_key string, message string, fired_at timestamp_ntz")
    fired = al.fire_alerts(mk(spark, rows, PROPOSAL), old, "2026-07-01 12:00:00").collect()
    assert len(fired) == 1 and fired[0].fired_at == ts("2026-07-01 12:00:00") and fired[0].severity == "warn"


def test_pauses_keep_the_proposal_as_snapshot(spark):
    fired = mk(spark, [(APP, "cpfo_high", "warn", "c", None, "k", "m", 900.0, 500.0, "too high")], PROPOSAL)
    ent = mk(spark, [(1, APP, "meta", "campaign", "x1", "c")], "id long, app string, channel string, level string, external_id string, name string")
    row = al.propose_pauses(fired, ent, "2026-07-01 12:00:00").collect()[0]
    assert '"observed":900.0' in row.state_snapshot and '"city":null' in row.state_snapshot
    refs = mk(spark, [(APP, "meta", "ad", "e", "r", "c")], "app string, channel string, entity_level string, external_id string, reason string, correlation_id string")
    assert al.propose_action(refs, "pause", None, "human", "2026-07-01 12:00:00").collect()[0].state_snapshot is None


def test_approving_one_decision_keeps_the_others(spark):
    dec = mk(spark, [(1, "approved", "ann", ts("2026-06-01 00:00:00")), (2, "proposed", None, None), (3, "proposed", None, None)],
             "id long, status string, approved_by string, approved_at timestamp_ntz")
    app = mk(spark, [(2, "bob"), (2, "zoe"), (1, "bob"), (9, "bob")], "id long, approved_by string")
    updated, rejected = al.approve_decisions(dec, app, "2026-07-01 12:00:00")
    got = {r.id: (r.status, r.approved_by, r.approved_at) for r in updated.collect()}
    assert got == {1: ("approved", "ann", ts("2026-06-01 00:00:00")), 2: ("approved", "bob", ts("2026-07-01 12:00:00")), 3: ("proposed", None, None)}
    assert updated.count() == 3 and {(r.id, r.error) for r in rejected.collect()} == {(1, "not in proposed state"), (9, "not found")}


def test_lists_are_whole_without_a_limit(spark):
    dec = spark.range(450).select("id", F.lit(APP).alias("app"), F.lit("proposed").alias("status"),
                                  F.lit("2026-07-01").cast("timestamp_ntz").alias("proposed_at"))
    rows = al.list_decisions(dec, APP).collect()
    assert [r.id for r in rows] == list(range(449, -1, -1)) and al.list_decisions(dec, APP, n=3).count() == 3


def test_registry_changes_keep_what_they_do_not_name(spark):
    target = mk(spark, [(1, APP, "app", "el_a", "hourly", True, "first", ts("2026-01-01 00:00:00"), ts("2026-01-02 00:00:00")),
                        (2, APP, "app", "el_b", "daily", True, "second", ts("2026-01-01 00:00:00"), ts("2026-01-02 00:00:00"))],
                "id int, app string, source string, event_name string, expected_frequency string, is_active boolean, description string, "
                "created_at timestamp_ntz, updated_at timestamp_ntz")
    changes = mk(spark, [("update", 2, None, None, "el_c", None, None, "renamed", 1), ("insert", None, APP, "click", None, "daily", None, "x", 2),
                         ("insert", None, APP, "click", None, "hourly", None, "y", 3), ("update", 1, None, None, "el_c", None, None, None, 4)],
                 "op string, id int, app string, source string, event_name string, expected_frequency string, is_active boolean, description string, n int")
    reg, conflicts = ig.upsert_registry(target, changes.where("n < 4"), "2026-07-01 00:00:00", order=["n"])
    rows = {r.id: r for r in reg.collect()}
    assert (rows[1].description, rows[1].updated_at) == ("first", ts("2026-01-02 00:00:00"))
    assert (rows[2].event_name, rows[2].description, rows[2].expected_frequency) == ("el_c", "renamed", "daily")
    assert (rows[2].created_at, rows[2].updated_at) == (ts("2026-01-01 00:00:00"), ts("2026-07-01 00:00:00"))
    assert (rows[3].source, rows[3].expected_frequency, rows[3].description) == ("click", "daily", "x")
    assert [(r.source, r.event_name) for r in conflicts.collect()] == [("click", "")]
    reg, conflicts = ig.upsert_registry(target, changes, "2026-07-01 00:00:00", order=["n"])   # two renames onto one key
    assert {r.event_name for r in reg.collect()} == {"el_a", "el_b", ""} and conflicts.count() == 3


def test_seeding_keeps_bookkeeping_and_numbers_new_rows(spark):
    target = mk(spark, [(4, APP, "a", "old", "d0", "{}", 60, "paused", True, 17, 250)],
                "id long, app string, slug string, name string, description string, definition string, refresh_interval_minutes int, "
                "status string, is_system boolean, last_count int, last_refresh_ms int")
    specs = mk(spark, [(APP, "a", "new", "d1", "{1}", 30, False), (APP, "b", "b", "d2", "{}", 30, False), (APP, "c", "c", None, "{}", 30, True)],
               "app string, slug string, name string, description string, definition string, refresh_interval_minutes int, needs_events boolean")
    rows = {r.slug: r for r in ig.seed_segments(target, specs, False, "2026-07-01 00:00:00").collect()}
    a = rows["a"]
    assert (a.id, a.name, a.description, a.status, a.last_count, a.last_refresh_ms) == (4, "new", "d1", "paused", 17, 250)
    assert [(rows[k].id, rows[k].status, rows[k].is_system) for k in "bc"] == [(5, "active", True), (6, "paused", True)]


def test_upserts_pick_the_same_row_of_a_repeated_key(spark):
    rows = [(APP, "meta", "campaign", "c1", f"n{k}", k) for k in (3, 1, 2)]
    batch = mk(spark, rows, "app string, channel string, level string, external_id string, name string, n int")
    tgt = mk(spark, [], "id long, app string, channel string, level string, external_id string, parent_external_id string, name string, city string, "
                        "category string, objective string, status string, current_daily_budget_inr decimal(14,2), currency string, "
                        "created_at timestamp_ntz, updated_at timestamp_ntz")
    assert [r.name for r in ig.upsert_entities(tgt, batch, "2026-07-01 00:00:00", order=["n"]).collect()] == ["n1"]


@pytest.mark.parametrize("space", ["\t", "\u00a0", " \n", "\u3000", "\ufeff", "\u2003"])
def test_all_white_space_is_trimmed(spark, space):
    df = mk(spark, [(f"{space}Mumbai{space}_cat{space}_leads",)], "s string")
    r = df.select(parse_campaign_name("s").alias("p"), js_trim(F.lit(f"{space}x y{space}")).alias("t"),
                  ob.pii_hash(F.lit(f"X{space}")).alias("h"), F.sha2(F.lit("x"), 256).alias("want")).collect()[0]
    assert (r.p.city, r.p.category, r.t) == ("mumbai", "cat", "x y") and r.h == r.want


def test_empty_currency_passes(spark):
    ok, bad = ig.assert_currency(mk(spark, [("INR",), ("",), (None,), ("usd",)], "currency string"))
    assert ok.count() == 3 and [r.currency for r in bad.collect()] == ["usd"]


def test_events_of_a_zone_behind_utc_are_read(spark):
    base = tempfile.mkdtemp(prefix="touchline-ev-")
    ev = mk(spark, [("1", APP, "a", ts("2024-02-01 03:00:00"))], "event_id string, app string, event_name string, occurred_at timestamp_ntz")
    tables.write_events(ev, f"{base}/events", zone="America/New_York")
    assert tables.read_events(spark, f"{base}/events", APP, "2024-02-01", "2024-02-03").count() == 1


def test_unreadable_target_is_an_error_not_an_empty_table(spark):
    base = tempfile.mkdtemp(prefix="touchline-sink-")
    df = mk(spark, [(1, "a"), (1, "b"), (2, "c")], "id long, v string")
    assert sinks.append_new(df, f"{base}/t", ["id"]) == 2 and sinks.append_new(df, f"{base}/t", ["id"]) == 0
    with open(f"{base}/t/part-broken.parquet", "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        sinks.append_new(df, f"{base}/t", ["id"])


def _run(spark, base, rows, n):
    df = mk(spark, rows, "event_id string, app string, event_name string, occurred_at timestamp_ntz, received_at timestamp_ntz, "
                         "session_id string, user_id long, platform string, app_version string, props string")
    df.coalesce(1).write.mode("append").option("timestampNTZFormat", st.TS_FORMAT).json(f"{base}/in")
    st.start_event_ingest(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt").awaitTermination()
    return st.stored_events(spark, f"{base}/out")


def test_late_events_are_stored_once(spark):
    base = tempfile.mkdtemp(prefix="touchline-late-")
    row = lambda k, at: (f"123e4567-e89b-42d3-a456-{k:012d}", APP, "el_a", ts(at), ts(at), "s", 1, "ios", "1", None)
    assert _run(spark, base, [row(1, "2026-07-01 10:00:00")], 0).count() == 1
    out = _run(spark, base, [row(2, "2026-01-01 10:00:00"), row(1, "2026-07-01 10:00:00"), row(3, "2026-07-02 10:00:00"), row(3, "2026-07-02 10:00:00")], 1)
    assert sorted(r.event_id[-1] for r in out.collect()) == ["1", "2", "3"]


def test_events_sent_again_months_later_are_stored_once(spark):
    base = tempfile.mkdtemp(prefix="touchline-again-")
    row = lambda k, at, got: (f"123e4567-e89b-42d3-a456-{k:012d}", APP, "el_a", ts(at), ts(got), "s", 1, "ios", "1", None)
    sent = [(1, "2026-01-10 10:00:00", "2026-01-10 10:00:00"), (2, "2026-01-10 10:00:00", "2026-07-10 10:00:00"),
            (3, "2027-06-01 10:00:00", "2026-01-10 10:00:00")]               # on time, late, by a clock that is ahead
    again = [(1, "2026-01-10 10:00:00", "2026-04-25 10:00:00"), (2, "2026-01-10 10:00:00", "2026-01-10 10:00:00"),
             (3, "2027-06-01 10:00:00", "2026-05-10 10:00:00")]
    assert _run(spark, base, [row(*r) for r in sent], 0).count() == 3
    for n, r in enumerate(again):                         # each in a batch whose months no other event widens
        out = _run(spark, base, [row(*r)], n + 1)
    assert sorted(r.event_id[-1] for r in out.collect()) == ["1", "2", "3"]


def test_late_rows_count_in_the_health_figures(spark):
    base = tempfile.mkdtemp(prefix="touchline-health-")
    for k, at in enumerate(("2026-07-01 11:00:00", "2026-07-01 05:00:00", "2026-07-01 05:30:00")):
        mk(spark, [("app", "el_a", ts(at))], "source string, event_name string, ts timestamp_ntz").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("source string, event_name string, ts timestamp_ntz").parquet(f"{base}/in")
        stream.writeStream.foreachBatch(st.health_batch(f"{base}/out")).option("checkpointLocation", f"{base}/ckpt").trigger(
            availableNow=True).start().awaitTermination()
    r = st.rollup_health(st.health_counts(spark, f"{base}/out"), "2026-07-01 12:00:00").collect()[0]
    assert (r.count_24h, r.count_7d, r.last_seen) == (3, 3, ts("2026-07-01 11:00:00"))


def test_health_figures_hold_the_first_partial_hour(spark):
    base = tempfile.mkdtemp(prefix="touchline-health-")
    at = ["2026-06-30 12:29:59", "2026-06-30 12:30:00", "2026-06-30 12:45:00", "2026-06-24 12:29:00", "2026-06-24 12:31:00"]
    batch = mk(spark, [("app", "el_a", ts(x)) for x in at], "source string, event_name string, ts timestamp_ntz")
    st.health_batch(base)(batch, 0)
    r = st.rollup_health(st.health_counts(spark, base), "2026-07-01 12:30:00").collect()[0]
    assert (r.count_24h, r.count_7d, r.last_seen) == (2, 4, ts("2026-06-30 12:45:00"))
    with pytest.raises(ValueError):
        st.rollup_health(st.health_counts(spark, base), "2026-07-01 12:30:01")


def test_segments_without_members_are_refreshed(spark):
    segs = mk(spark, [(1, "a"), (2, "b")], "id long, slug string")
    members = mk(spark, [(1, 10), (1, 11)], "segment_id long, user_id long")
    got = {r.id: r.last_count for r in sg.refresh_bookkeeping(segs, members, "2026-07-01 00:00:00").collect()}
    assert got == {1: 2, 2: 0}
    with pytest.raises(ValueError):
        sg.segment_members(members, 1, None, 10_001)


def test_segment_plans_read_only_what_they_need(spark):
    from touchline.plans.params import APP as app, NOW
    from touchline.plans.q_segments import SEG_DEFS
    conv = spark.range(9).select(F.lit(app).alias("app"), F.col("id").alias("user_id"), F.lit("2024-01-30").cast("timestamp_ntz").alias("occurred_at"),
                                 F.lit(1).cast("decimal(10,2)").alias("value_inr"), F.lit("c").alias("city"), F.lit("k").alias("category"))
    events = mk(spark, [(app, 1, "el_add_to_cart", ts("2024-01-30 00:00:00"), None)],
                "app string, user_id long, event_name string, occurred_at timestamp_ntz, props string")

    def plan(name):
        return sg.membership(SEG_DEFS[name], conv, events, app, NOW)._jdf.queryExecution().optimizedPlan().toString()
    assert "event_name" not in plan("seg_recency")
    one = plan("seg_event")
    assert "Join" not in one and "event_name" in one and ">=" in one
    assert "Join" in plan("seg_event_not")


def test_leads_are_acknowledged_by_their_own_ids(spark):
    leads = mk(spark, [(k, APP, f"w{k}", None, ts(f"2026-07-01 0{k}:00:00"), None) for k in range(1, 6)],
               "id long, app string, ctwa_clid string, wa_phone_hash string, occurred_at timestamp_ntz, capi_uploaded_at timestamp_ntz")
    b = ob.batch_outbox(ob.lead_payload(ob.pending_leads(leads, APP)), ["occurred_at", "id"], 2, key_col="id")
    marked = ob.apply_acks(leads, b, b.select("app", "batch", (F.col("batch") < 1).alias("ok")), "2026-07-02 00:00:00", key="id")
    assert {r.id for r in marked.where("capi_uploaded_at IS NOT NULL").collect()} == {1, 2}


def test_purchase_envelopes(spark):
    rows = [("o1", 1, "Pune", ts("2026-07-01 00:00:00"), 10.5, "f", None, "clid", "app"), ("o2", None, "", ts("2026-07-01 00:00:00"), 1.0, "", "p", None, "app"),
            ("o3", 2, None, ts("2026-07-01 00:00:00"), 1.0, None, None, "", "website")]
    df = mk(spark, rows, "order_id string, user_id long, city string, occurred_at timestamp_ntz, value_inr double, fbc string, fbp string, "
                         "ctwa_clid string, action_source string").withColumn("app", F.lit(APP))
    got = {r.event_id: r for r in ob.purchase_payload(df).collect()}
    assert [(got[k].action_source, got[k].messaging_channel, got[k].ctwa_clid) for k in ("o1", "o2", "o3")] == [
        ("business_messaging", "whatsapp", "clid"), ("app", None, None), ("website", None, None)]
    assert '"user_data":{"fbp":"p"}' in got["o2"].payload and '"value":10.5' in got["o1"].payload


def test_heavy_keys_choose_the_splitting_form(spark):
    from touchline.operators.asof import asof_last, choose_mode
    rows = [(k, 1 if k % 3 else k, ts("2026-07-01 00:00:00")) for k in range(900)]       # two thirds on one key in one instant's week
    src = mk(spark, rows, "id long, user_id long, occurred_at timestamp_ntz").withColumn(
        "occurred_at", F.col("occurred_at") + F.make_dt_interval(mins=F.col("id").cast("int")))
    tgt = src.select((F.col("id") + 5000).alias("id"), "user_id", (F.col("occurred_at") + F.make_dt_interval(secs=F.lit(1))).alias("occurred_at"))
    one = [(src, ["user_id"], "occurred_at")]
    assert choose_mode(one, 7) == "single" and choose_mode(one, 7, heavy_rows=1000, small_bytes=0) == "single"
    assert choose_mode(one, 7, heavy_rows=100, small_bytes=0) == "range"
    common = dict(target_key="user_id", target_ts="occurred_at", target_id="id", source_key="user_id", source_ts="occurred_at",
                  source_tiebreak=["id"], source_cols=["id"], lookback_days=7)
    got = [{r.id: r.match.id for r in asof_last(tgt, src, mode=m, **common).collect()} for m in ("replicate", "range")]
    assert got[0] == got[1] == {k + 5000: k for k in range(900)}
