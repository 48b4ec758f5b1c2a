"""Stored tables: atomic replacement of partitions, keyed inserts, dropped months."""

import datetime as dt
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.conftest import mk, ts
from tests.test_streaming import spoil
from touchline.sources import tables
from touchline.sources.sinks import KeyedTable
from touchline.sources.versions import VersionedTable

SCHEMA = "k long, v string, day date"


def rows(spark, *values):
    return spark.createDataFrame([(k, v, dt.date.fromisoformat(d)) for k, v, d in values], SCHEMA)


def held(df):
    return sorted((r.k, r.v, str(r.day)) for r in df.collect())


def test_a_write_replaces_its_partitions_at_once(spark, monkeypatch):
    table = VersionedTable(spark, tempfile.mkdtemp(prefix="touchline-ver-"), SCHEMA, "day")
    assert table.read().count() == 0
    first = [(1, "a", "2026-01-01"), (2, "a", "2026-01-02"), (3, "a", "2026-01-03")]
    table.write(rows(spark, *first), [])
    d2, d3 = dt.date(2026, 1, 2), dt.date(2026, 1, 3)
    plan = table.read([d2])
    assert held(plan) == [first[1]] and all("day=2026-01-02" in f for f in plan.inputFiles())

    with monkeypatch.context() as m:                       # killed after the data, before the list
        m.setattr(VersionedTable, "_commit", lambda self, version, text: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            table.write(rows(spark, (9, "x", "2026-01-02"), (9, "x", "2026-01-03")), [d2, d3])
    assert held(table.read()) == first

    spoil(f"{table.path}/data/version=0/day=2026-01-01")   # a write reads and touches its own days only
    table.write(table.read([d2]).withColumn("v", F.lit("b")), [d2, d3])
    assert held(table.read([d2, d3])) == [(2, "b", "2026-01-02")] and set(table.parts()) == {"day=2026-01-01", "day=2026-01-02"}
    for k in range(3):
        table.write(rows(spark, (k, "c", "2026-01-02")), [d2])
    assert held(table.read([d2])) == [(2, "c", "2026-01-02")] and len(table.versions()) <= 3
    assert len(list(Path(f"{table.path}/data").iterdir())) <= 4


def test_of_two_writes_of_one_version_one_fails(spark):
    table = VersionedTable(spark, tempfile.mkdtemp(prefix="touchline-ver-"), SCHEMA, "day")
    table.write(rows(spark, (1, "a", "2026-01-01")), [])
    with pytest.raises(RuntimeError):
        table._commit(0, "")
    assert held(table.read()) == [(1, "a", "2026-01-01")]


def test_keyed_inserts_read_only_their_buckets(spark):
    table = KeyedTable(spark, tempfile.mkdtemp(prefix="touchline-key-"), ["app", "id"], buckets=8, every=None)
    schema = "app string, id long, v long"
    got = table.insert(spark.createDataFrame([("s", k, v) for k in range(40) for v in (2, 1)], schema), 0, ["v"])
    assert sorted((r.id, r.v) for r in got.collect()) == [(k, 1) for k in range(40)]
    again = spark.createDataFrame([("s", 5, 9), ("s", 100, 9), ("t", 5, 9)], schema)
    of = lambda df: {r[0] for r in df.select(F.pmod(F.xxhash64("app", "id"), F.lit(8))).collect()}
    touched = of(again)
    assert len(touched) < 8
    for f in Path(f"{table.table.path}/batch_id=0").glob("key_bucket=*"):
        if int(f.name.split("=")[1]) not in touched:
            spoil(f)
    for _ in range(2):                                     # and a retry
        assert sorted((r.app, r.id) for r in table.insert(again, 1).collect()) == [("s", 100), ("t", 5)]


def test_months_out_of_retention_are_dropped_by_name(spark):
    base = tempfile.mkdtemp(prefix="touchline-months-")
    days = ["2025-01-15", "2025-06-15", "2025-07-15", "2026-06-15", "2026-08-15", "2026-09-15"]
    ev = mk(spark, [(d, app, "a", ts(f"{d} 03:00:00")) for d in days for app in ("x", "y")], "event_id string, app string, event_name string, occurred_at timestamp_ntz")
    tables.write_events(ev, base)
    Path(f"{base}/app=x/other").mkdir()
    spoil(base)                                            # no event file is opened
    before = {p: p.stat().st_mtime_ns for p in Path(base).rglob("event_month=*")}
    gone = tables.drop_event_months(spark, base, "2026-06-20 00:00:00", 13)
    left = {p: p.stat().st_mtime_ns for p in Path(base).rglob("event_month=*")}
    assert sorted({m for _, m in gone}) == ["2025_01", "2026_09"] or sorted({m for _, m in gone}) == ["2025_01", "2025_05", "2026_09"]
    assert {p.name[-7:] for p in left} == {"2025_06", "2025_07", "2026_06", "2026_08"} and all(before[p] == t for p, t in left.items())
    assert Path(f"{base}/app=x/other").exists() and tables.drop_event_months(spark, base, "2026-06-20 00:00:00", 13) == []
