"""Streams over many micro-batches: what is stored, what is read, retries, merges."""

import datetime as dt
import random
import tempfile
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.conftest import mk, ts
from touchline.operators.attribution import resolve_attribution
from touchline.operators.identity import backfill_touch_users
from touchline.sources.batches import BatchTable
from touchline.streaming import ingest as st
from touchline.streaming.keyed import start_keyed

APP = "services"


def folder():
    return tempfile.mkdtemp(prefix="touchline-stream-")


def spoil(path, pattern="*.parquet"):
    """Data files that would fail any read of them."""
    for f in Path(path).rglob(pattern):
        f.write_bytes(b"not to be read")
    for f in Path(path).rglob(".*.crc"):
        f.unlink()


def test_batch_table_merges_and_keeps_retries_idempotent(spark):
    table = BatchTable(spark, folder(), every=3)
    batch = lambda k: spark.createDataFrame([(k, 10 * k), (k, 10 * k + 1)], "k long, v long")
    for k in range(15):
        table.write(batch(k), k)
        assert len(table.parts()) <= 8
    want = Counter((k, v, k) for k in range(15) for v in (10 * k, 10 * k + 1))
    assert Counter(map(tuple, table.read("k long, v long").collect())) == want
    assert max(p.level for p in table.parts()) == 2 and table.covered(4)
    for k in (4, 12, 14):                                  # merged long ago, lately, and not yet
        table.write(batch(k), k)
    assert Counter(map(tuple, table.read("k long, v long").collect())) == want
    assert sum(1 for _ in Path(table.path).iterdir()) < 25


def test_a_merge_without_its_mark_is_not_seen(spark):
    table = BatchTable(spark, folder(), every=None)
    for k in range(4):
        table.write(spark.createDataFrame([(k,)], "k long"), k)
    spark.createDataFrame([(77, 3)], "k long, batch long").write.parquet(f"{table.path}/run=1_0_3")      # died before the mark
    assert sorted(r.k for r in table.read("k long").collect()) == [0, 1, 2, 3]
    table.every = 2
    table.write(spark.createDataFrame([(4,)], "k long"), 4)
    assert sorted(r.k for r in table.read("k long").collect()) == [0, 1, 2, 3, 4] and table.covered(3)


def test_partitioned_batch_tables_keep_their_columns(spark):
    table = BatchTable(spark, folder(), ("p",), every=2)
    for k in range(5):
        table.write(spark.createDataFrame([(k, f"x{k % 2}")] if k != 2 else [], "k long, p string"), k)
    got = table.read("k long, p string")
    assert Counter((r.k, r.p) for r in got.collect()) == Counter((k, f"x{k % 2}") for k in (0, 1, 3, 4))
    assert "PartitionFilters: [isnotnull(p" in got.where("p = 'x1'")._jdf.queryExecution().toString()


def events(spark, base, n, rows):
    df = mk(spark, rows, "event_id string, app string, event_name string, occurred_at timestamp_ntz, received_at timestamp_ntz, "
                         "session_id string, user_id long, platform string, app_version string, props string")
    df.coalesce(1).write.option("timestampNTZFormat", st.TS_FORMAT).json(f"{base}/in/{n:03}")
    st.start_event_ingest(spark, f"{base}/in/*", f"{base}/out", f"{base}/ckpt", every=None).awaitTermination()


def test_event_dedup_reads_nothing_that_is_stored(spark):
    """A redelivery is dropped after any time, by keyed state: the stored files can't even be read."""
    base = folder()
    row = lambda k, day: (f"123e4567-e89b-42d3-a456-{k:012d}", APP, "el_a", day, day, "s", 1, "ios", "1", None)
    start, seen = dt.datetime(2026, 1, 1), set()
    for n in range(5):
        day = start + dt.timedelta(days=40 * n)
        ids = [10 * n + k for k in range(5)] + [k for k in (0, 10 * n - 8) if k >= 0]      # new ones, and old ones again
        events(spark, base, n, [row(k, day) for k in ids])
        files = [f for f in Path(f"{base}/out/batch_id={n}").rglob("*.parquet")]
        stored = [r.event_id for r in spark.read.parquet(*map(str, files)).select("event_id").collect()]
        assert Counter(stored) == Counter(f"123e4567-e89b-42d3-a456-{k:012d}" for k in set(ids) - seen)
        seen |= set(ids)
        spoil(f"{base}/out")


def test_keys_known_before_the_stream_are_not_stored(spark):
    base = folder()
    schema = "k long, known boolean"
    for name, rows in (("a", [(1, True), (2, True)]), ("b", [(1, False), (3, False), (3, False)])):
        spark.createDataFrame(rows, schema).write.parquet(f"{base}/in/{name}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/in")
        start_keyed(stream, ["k"], f"{base}/out", f"{base}/ckpt", where="NOT known").awaitTermination()
    assert [r.k for r in BatchTable(spark, f"{base}/out").read(schema).collect()] == [3]


TOUCH = ("id long, app string, occurred_at timestamp_ntz, received_at timestamp_ntz, channel string, gclid string, fbclid string, "
         "fbc string, fbp string, utm_source string, utm_campaign string, touch_type string, session_id string, user_id long")
CONVERSION = ("id long, app string, order_id string, user_id long, occurred_at timestamp_ntz, value_inr decimal(10,2), "
              "is_first_order boolean, city string, category string, session_id string")
ENTITY = ("id long, app string, channel string, level string, external_id string, parent_external_id string, name string, city string, category string")


def attribution_tables(spark, seed):
    rng = random.Random(seed)
    at = lambda: dt.datetime(2026, 6, 1) + dt.timedelta(minutes=rng.randrange(0, 40 * 24 * 60, 97))
    who = lambda: (rng.choice(["s1", "s2", "s3", "", None]), rng.choice([1, 2, 3, None]))
    touches = [(k, APP, t := at(), t, None, None, None, None, None, rng.choice(["facebook", "google", "x"]), rng.choice(["c_x_y", "d_x_y", None]),
                "touch", *who()) for k in range(60)]
    conversions = []
    for k in range(25):
        s, u = who()
        conversions.append((k, APP, f"O{k}", u, at(), 10, True, None, None, s))
    entities = [(1, APP, "meta", "campaign", "c1", None, "c_x_y", "c", "x"), (2, APP, "google", "campaign", "c2", None, "d_x_y", "d", "x")]
    return mk(spark, touches, TOUCH), mk(spark, conversions, CONVERSION), mk(spark, entities, ENTITY)


def verdicts(df):
    return {r.order_id: (r.attributed_touch_id, r.attributed_entity_id, r.attribution_outcome) for r in df.collect()}


@pytest.mark.parametrize("order", ["touches last", "conversions last", "mixed"])
def test_attribution_does_not_depend_on_the_order_of_arrival(spark, order):
    touches, conversions, entities = attribution_tables(spark, 5)
    want = verdicts(resolve_attribution(conversions, touches, entities, APP, 7))
    assert len(set(v[0] for v in want.values())) > 5
    part = lambda df, k, n: df.where(F.pmod(F.hash("id"), F.lit(n)) == k)
    none = lambda df: df.limit(0)
    batches = {"touches last": [(none(touches), conversions), (part(touches, 0, 2), none(conversions)), (part(touches, 1, 2), none(conversions))],
               "conversions last": [(touches, none(conversions)), (none(touches), conversions)],
               "mixed": [(part(touches, k, 3), part(conversions, 2 - k, 3)) for k in range(3)]}[order]
    store = folder()
    run = st.attribution_batch(store, lambda spark: entities, APP, 7, every=2)
    for n, (t, c) in enumerate(batches):
        run(st.attribution_rows(t, c), n)
        run(st.attribution_rows(t, c), n)                  # a retry
    assert verdicts(st.attributed(spark, store, conversions.schema)) == want


def test_a_late_touch_reads_only_the_days_that_it_can_reach(spark):
    touches, conversions, entities = attribution_tables(spark, 6)
    store = folder()
    run = st.attribution_batch(store, entities, APP, 7, every=None)
    late = touches.where("id = 0").withColumn("occurred_at", F.lit("2026-06-03 00:00:00").cast("timestamp_ntz"))
    early = touches.where("id > 0")
    run(st.attribution_rows(early, conversions), 0)
    for kind in ("touch", "conversion"):
        for day in Path(f"{store}/{kind}/batch_id=0").glob("day=*"):
            if not "2026-05-20" <= day.name[4:] <= "2026-06-10":
                spoil(day)
    run(st.attribution_rows(late, conversions.limit(0)), 1)
    want = verdicts(resolve_attribution(conversions, early.unionByName(late), entities, APP, 7))
    assert verdicts(st.attributed(spark, store, conversions.schema)) == want


def test_health_counts_stay_few_and_right(spark):
    base, rng, rows = folder(), random.Random(1), []
    run = st.health_batch(base, every=4)
    for n in range(18):
        new = [(rng.choice(["app", "lead"]), rng.choice(["a", None]), dt.datetime(2026, 6, 1) + dt.timedelta(days=n // 2, minutes=rng.randrange(0, 2880, 360)))
               for _ in range(30)] + [("app", "a", dt.datetime(2026, 5, 1, 3, n))]             # some long late
        rows += new
        run(mk(spark, new, "source string, event_name string, ts timestamp_ntz"), n)
    assert len(BatchTable(spark, base).parts()) <= 8
    counts = st.health_counts(spark, base)
    assert counts.count() < 0.6 * len(rows)
    now = dt.datetime(2026, 6, 10, 7, 13)
    want = {}
    for s, e, at in rows:
        c = want.setdefault((s, e), [0, 0, at])
        c[0] += at >= now - dt.timedelta(hours=24)
        c[1] += at >= now - dt.timedelta(days=7)
        c[2] = max(c[2], at)
    got = {(r.source, r.event_name): [r.count_24h, r.count_7d, r.last_seen] for r in st.rollup_health(counts, str(now)).collect()}
    assert got == want
    with pytest.raises(Exception, match="merged by day"):
        st.rollup_health(counts, "2026-05-02 00:00:00").collect()


def test_backfill_reads_the_buckets_of_its_sessions(spark):
    base, rng = folder(), random.Random(2)
    rows = []
    for k in range(120):
        at = ts("2026-06-01 00:00:00") + dt.timedelta(minutes=rng.randrange(5000))
        rows.append((k, APP, at, at, None, None, None, None, None, None, None, "touch", rng.choice(["s1", "s2", "s3", "s4", None]), rng.choice([1, 2, None, None])))
    df = mk(spark, rows, TOUCH)
    want = {r.id: r.user_id for r in backfill_touch_users(df).collect()}
    run = st.touch_backfill_batch(f"{base}/touches", f"{base}/fills", buckets=16, every=2)
    for n in range(4):
        run(df.where(F.pmod(F.hash("id"), F.lit(4)) == n), n)
    got = {r.id: r.user_id for r in st.backfilled_touches(spark, f"{base}/touches", f"{base}/fills", df.schema).collect()}
    assert got == want
    own = spark.range(1).select(F.pmod(F.xxhash64(F.lit(APP), F.lit("s1")), F.lit(16)).cast("int")).first()[0]
    for d in Path(f"{base}/touches").rglob("bucket=*"):
        if d.name != f"bucket={own}":
            spoil(d)
    run = st.touch_backfill_batch(f"{base}/touches", f"{base}/fills", buckets=16, every=None)
    run(mk(spark, [(999, APP, *[ts("2026-07-01 00:00:00")] * 2, *[None] * 7, "touch", "s1", 9)], TOUCH), 9)
    fills = BatchTable(spark, f"{base}/fills").read("id long, user_id long").where("batch = 9").collect()
    assert {r.id: r.user_id for r in fills} == {k: want[k] or 9 for k, r in ((r[0], r) for r in rows) if r[12] == "s1" and r[13] is None}
