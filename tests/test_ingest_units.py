"""Unit cases for the metadata upserts, the registry validator and the
foreachBatch streaming helpers."""

import datetime as dt
import json
import tempfile

from pyspark.sql import functions as F

from conftest import mk, ts
from touchline.operators import ingest as ig
from touchline.streaming import ingest as st

APP = "services"


def test_rolling_window():
    assert ig.rolling_window("2026-07-10 05:00:00", 8) == ("2026-07-03", "2026-07-10")


def test_validate_registry(spark):
    rows = [(APP, "app", None, None, None, None), (APP, "pixel", "x", "daily", None, True),
            (APP, "app", "Bad-Name", "daily", None, True), (APP, "click", "", "yearly", "d" * 501, True)]
    df = mk(spark, rows, "app string, source string, event_name string, expected_frequency string, "
                         "description string, is_active boolean")
    out = ig.validate_registry(df).collect()
    assert out[0].reasons == [] and out[0].event_name == "" and out[0].expected_frequency == "none" and out[0].is_active
    assert out[1].reasons == ["source"]
    assert out[2].reasons == ["event_name"]
    assert out[3].reasons == ["expected_frequency", "description"]


def test_upsert_registry(spark):
    target = mk(spark, [(1, APP, "app", "el_a", "hourly", True), (2, APP, "app", "", "daily", True)],
                "id int, app string, source string, event_name string, expected_frequency string, is_active boolean")
    changes = mk(spark, [("insert", None, APP, "click", None, "daily", None),
                         ("insert", None, APP, "app", "el_a", "daily", None),     # key clash
                         ("update", 2, None, None, None, "weekly", False),
                         ("delete", 1, None, None, None, None, None)],
                 "op string, id int, app string, source string, event_name string, expected_frequency string, "
                 "is_active boolean")
    reg, conflicts = ig.upsert_registry(target, changes, "2026-07-01 00:00:00")
    rows = [(r.id, r.source, r.event_name, r.expected_frequency, r.is_active) for r in reg.collect()]
    assert rows == [(2, "app", "", "weekly", False), (3, "click", "", "daily", True)]
    assert [(r.source, r.event_name) for r in conflicts.collect()] == [("app", "el_a")]


def test_seed_segments_keeps_bookkeeping(spark):
    target = mk(spark, [(1, APP, "repeat_buyers", "old", "{}", 60, "paused", True, ts("2026-06-01 00:00:00"),
                         ts("2026-06-01 00:00:00"))],
                "id long, app string, slug string, name string, definition string, refresh_interval_minutes int, "
                "status string, is_system boolean, last_refreshed_at timestamp_ntz, updated_at timestamp_ntz")
    specs = mk(spark, [(APP, "repeat_buyers", "Repeat buyers", json.dumps({"v": 1}), 360, False),
                       (APP, "cart_abandoners_48h", "Cart abandoners", "{}", 180, True)],
               "app string, slug string, name string, definition string, refresh_interval_minutes int, needs_events boolean")
    out = {r.slug: r for r in ig.seed_segments(target, specs, events_available=False, now="2026-07-01 00:00:00").collect()}
    rb = out["repeat_buyers"]
    assert (rb.name, rb.refresh_interval_minutes, rb.status, rb.last_refreshed_at) == \
        ("Repeat buyers", 360, "paused", ts("2026-06-01 00:00:00"))
    assert out["cart_abandoners_48h"].status == "paused" and out["cart_abandoners_48h"].id == 2


def test_snapshot_reviews_first_write_wins(spark):
    rows = [(APP, "app_store", ts("2026-07-01 03:00:00"), 4.456, 120, None),
            (APP, "app_store", ts("2026-07-01 05:00:00"), 3.0, 121, None),        # same IST day → ignored
            (APP, "play_store", ts("2026-07-01 03:00:00"), None, None, [{"star": 5}, {"star": None}, {"star": 4}])]
    df = mk(spark, rows, "app string, source string, observed_at timestamp_ntz, avg_rating double, rating_count int, "
                         "reviews array<struct<star:int>>")
    out = {r.source: r for r in ig.snapshot_reviews(df).collect()}
    a = out["app_store"]
    assert (float(a.rating_avg), a.rating_count, a.new_reviews_count) == (4.46, 120, None)
    p = out["play_store"]
    assert (float(p.rating_avg), p.rating_count, p.new_reviews_count) == (4.5, None, 3)


def test_segment_refresh_sink_replaces_partitions(spark):
    from touchline.sources.sinks import write_segment_refresh, replace_partitions
    from touchline.operators import segments as sg
    base = tempfile.mkdtemp(prefix="touchline-seg-")
    target = f"{base}/membership"
    conv = mk(spark, [(1, APP, "o1", 10, ts("2026-06-25 00:00:00"), 100, True, "x", "c", None),
                      (2, APP, "o2", 11, ts("2026-05-01 00:00:00"), 100, True, "y", "c", None)],
              "id long, app string, order_id string, user_id long, occurred_at timestamp_ntz, value_inr decimal(10,2), "
              "is_first_order boolean, city string, category string, session_id string")
    recent = {"version": 1, "group": {"op": "AND", "criteria": [{"kind": "order_recency", "op": "lte", "days": 30}]}}
    none = {"version": 1, "group": {"op": "AND", "criteria": [{"kind": "order_recency", "op": "lte", "days": 1}]}}
    # an old membership for segment 2 that must disappear
    old = mk(spark, [(2, 99, ts("2026-06-01 00:00:00"))], "segment_id long, user_id long, computed_at timestamp_ntz")
    replace_partitions(old, target, ["segment_id"])
    segs = [{"id": 1, "definition": json.dumps(recent)}, {"id": 2, "definition": json.dumps(none)},
            {"id": 3, "definition": json.dumps({"version": 2})}, {"id": 4, "definition": "{}", "status": "paused"}]
    book = {r.id: r for r in write_segment_refresh(segs, conv, None, APP, "2026-07-01 00:00:00", target).collect()}
    assert (book[1].status, book[1].last_count) == ("refreshed", 1)
    assert (book[2].status, book[2].last_count) == ("refreshed", 0)
    assert book[3].status == "error" and "version" in book[3].last_error
    assert book[4].status == "skipped"
    members = spark.read.parquet(target)
    assert sg.segment_members(members, 2, None, 10).collect()[0].total == 0
    assert sg.segment_members(members, 1, None, 10).collect()[0].user_ids == [10]


def test_events_partition_pruning(spark):
    from touchline.sources.tables import months_between, read_events, write_events
    assert months_between("2024-02-01", "2024-02-29") == ["2024_01", "2024_02", "2024_03"]
    base = tempfile.mkdtemp(prefix="touchline-ev-")
    ev = mk(spark, [("1", APP, "a", ts("2024-01-10 10:00:00")), ("2", APP, "b", ts("2024-03-10 10:00:00")),
                    ("3", "other", "c", ts("2024-01-11 10:00:00"))],
            "event_id string, app string, event_name string, occurred_at timestamp_ntz")
    write_events(ev, f"{base}/events")
    df = read_events(spark, f"{base}/events", APP, "2024-01-01", "2024-01-31")
    assert [r.event_id for r in df.collect()] == ["1"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "event_month" in plan


def test_upsert_entities_keeps_stored_columns(spark):
    tgt = mk(spark, [(5, APP, "meta", "campaign", "c1", None, "old_x_y", "old", "x", "y", "ACTIVE", None, None,
                      ts("2026-01-01 00:00:00"), ts("2026-01-01 00:00:00"))],
             "id long, app string, channel string, level string, external_id string, parent_external_id string, "
             "name string, city string, category string, objective string, status string, "
             "current_daily_budget_inr decimal(14,2), currency string, created_at timestamp_ntz, updated_at timestamp_ntz")
    batch = mk(spark, [(APP, "meta", "campaign", "c1", "p9", "Pune_Cleaning_Leads", "PAUSED", "USD"),
                       (APP, "meta", "adset", "a1", "c1", "set", "ACTIVE", "INR")],
               "app string, channel string, level string, external_id string, parent_external_id string, name string, "
               "status string, currency string")
    out = {r.external_id: r for r in ig.upsert_entities(tgt, batch, "2026-07-01 00:00:00").collect()}
    c1 = out["c1"]
    assert (c1.id, c1.parent_external_id, c1.currency, c1.name, c1.city, c1.objective, c1.status) == \
        (5, None, None, "Pune_Cleaning_Leads", "pune", "leads", "PAUSED")
    assert c1.created_at == ts("2026-01-01 00:00:00") and c1.updated_at == ts("2026-07-01 00:00:00")
    a1 = out["a1"]
    assert (a1.id, a1.parent_external_id, a1.currency) == (6, "c1", "INR")


def test_schemas_and_landed_reader(spark):
    from touchline.sources import schemas
    from touchline.sources.bindings import DriverTables
    t = DriverTables(spark, "/root/testdata/sf0.001")
    for table, df in [("ad_entity", t.ad_entity), ("attribution_touch", t.attribution_touch), ("app_event", t.app_event),
                      ("lead_event", t.lead_event), ("review_observation", t.review_observation)]:
        declared = {f.name for f in schemas.schema(table).fields}
        assert set(df.columns) <= declared, (table, set(df.columns) - declared)
    assert schemas.key("conversion") == ["app", "order_id"]
    base = tempfile.mkdtemp(prefix="touchline-landed-")
    with open(f"{base}/batch.json", "w") as fh:
        fh.write(json.dumps({"app": "services", "order_id": "O1", "user_id": 42, "value_inr": 1500.5,
                             "is_first_order": True, "occurred_at": "2026-06-20T10:00:00Z"}) + "\n")
        fh.write(json.dumps({"app": "services", "order_id": "O2", "user_id": "not-a-number", "value_inr": 1,
                             "is_first_order": False, "occurred_at": "2026-06-20T11:00:00.123Z"}) + "\n")
    rows = {r.order_id: r for r in schemas.read_landed(spark, base, "conversion").collect()}
    assert rows["O1"].user_id == 42 and float(rows["O1"].value_inr) == 1500.5
    assert rows["O1"].occurred_at == ts("2026-06-20 10:00:00")
    assert rows["O2"].user_id is None
    valid, bad = ig.split_valid(ig.validate_conversions(schemas.read_landed(spark, base, "conversion")))
    assert valid.count() == 2 and bad.count() == 0
