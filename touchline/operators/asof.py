"""As-of kernel: for every target row, the latest source row of the same key
at or before the target's time and no older than a lookback.

Spark has no as-of join operator. A range join (``s.ts BETWEEN t.ts - L AND
t.ts``) emits every pair inside the lookback and explodes on busy keys, so the
kernel is a sort-based sweep over time buckets instead. Two exact forms:

**Replicated buckets** (default when a lookback ``L`` is given). Time is cut
into buckets of ``bucket_hours`` (default: the lookback itself). A source at
``ts`` can only serve targets in ``[ts, ts + L]``, so it is copied into the
buckets ``bucket(ts) … bucket(ts + L)`` — exactly two when the bucket width is
``L``. Sources and targets are then sorted inside ``(key, bucket)``
partitions and a running ``last(source, ignorenulls)`` gives each target the
latest source at or before it; every source inside its lookback is in its
partition. One shuffle, sources copied ``L / width + 1`` times.

**Carried buckets** (no lookback, or ``forward=True``). Sources and targets
are sorted inside ``(key, bucket)``; each bucket's last source is reduced to
one row per ``(key, bucket)`` (a partial, map-side aggregate) and a window
over that reduced table — one row per bucket of the key's time span — carries
it to later buckets, joined back to targets whose own bucket had none.

At equal time sources sort before targets (the bound is inclusive) and
source ties sort by the tie-break columns, so the last one wins
deterministically. In both forms a task holds one key's rows for one time
bucket: a hot key (a bot identity, a shared session) is spread over as many
tasks as it has buckets, and no pair is ever materialised.
``bucket_hours=None`` is the plain single-window sweep (partition by key); ``choose_mode``
takes it where no key has more rows than a task should get.

**Range buckets** (``mode="range"``, or session conf
``touchline.asof.mode=range``) make the split independent of time: the
union is range-partitioned on ``(key, time, kind, tie-break)`` — Spark's
range partitioner samples that composite key, so a key with a third of all
rows inside one week is still cut into many partitions — and pinned with a
reliable checkpoint; the partition id then plays the bucket in the carried
form. It costs a sampling pass and a checkpoint write, so the callers take it
where ``choose_mode`` counts a group too large for a task, or where the
session conf asks for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(ts: Column, hours: int) -> Column:
    # zone-independent on timestamp_ntz: days since epoch × 24 + hour
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return F.floor((days * 24 + F.hour(ts)) / F.lit(hours)).cast("long")


def _sweep(both: DataFrame, mode: str, bucket_hours: int | None, lookback_days: int | None,
           forward: bool, keep_cols: list[str]) -> DataFrame:
    """Core sweep over the union of sources (``_kind`` 0) and targets (1).
    ``both`` has ``_k, _ts, _kind, _ord, _s`` plus payload columns; returns
    the target rows' ``keep_cols`` and the match ``_m``."""
    order = [F.col("_ts").desc(), F.col("_ord").desc()] if forward else [F.col("_ts"), F.col("_kind"), F.col("_ord")]
    run = Window.unboundedPreceding, Window.currentRow
    if mode == "single":
        w = Window.partitionBy("_k").orderBy(*order).rowsBetween(*run)
        hit = both.withColumn("_m", F.last("_s", ignorenulls=True).over(w)).where(F.col("_kind") == 1)
    elif mode == "replicate":
        reach = F.col("_ts") + F.make_dt_interval(days=F.lit(lookback_days))
        b0 = _bucket(F.col("_ts"), bucket_hours)
        both = both.select("*", F.explode(F.when(F.col("_kind") == 0, F.sequence(b0, _bucket(reach, bucket_hours)))
                                          .otherwise(F.array(b0))).alias("_b"))
        w = Window.partitionBy("_k", "_b").orderBy(*order).rowsBetween(*run)
        hit = both.withColumn("_m", F.last("_s", ignorenulls=True).over(w)).where(F.col("_kind") == 1)
    else:
        if mode == "range":
            # sorted global order of (key, time, kind, tie-break): Spark's range
            # partitioner samples the composite key, so one key's rows are split
            # across partitions by time. The checkpoint pins that assignment.
            from ..session import checkpoint_dir
            spark = both.sparkSession
            checkpoint_dir(spark)
            parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
            sort = [F.col("_k")] + [c for c in order]
            both = (both.repartitionByRange(parts, *sort).sortWithinPartitions(*sort)
                    .withColumn("_b", F.shiftright(F.monotonically_increasing_id(), 33))
                    .checkpoint(eager=True))   # partition ids follow the sweep order
        else:
            both = both.withColumn("_b", _bucket(F.col("_ts"), bucket_hours))
        w = Window.partitionBy("_k", "_b").orderBy(*order).rowsBetween(*run)
        same = (both.withColumn("_same", F.last("_s", ignorenulls=True).over(w))
                .where(F.col("_kind") == 1).drop("_s", "_ord"))
        # one row per (key, bucket): the bucket's last source in sweep order, or
        # NULL for buckets that only hold targets
        pick = F.min_by if forward else F.max_by
        per_bucket = (both.groupBy("_k", "_b")
                      .agg(pick(F.when(F.col("_kind") == 0, F.col("_s")),
                                F.when(F.col("_kind") == 0, F.struct("_ts", "_ord"))).alias("_lb"),
                           F.max("_kind").alias("_has_target")))
        # time buckets are numbered by time, range partitions by sweep order
        border = F.col("_b").desc() if (forward and mode != "range") else F.col("_b")
        wb = Window.partitionBy("_k").orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
        prior = (per_bucket.withColumn("_prior", F.last("_lb", ignorenulls=True).over(wb))
                 .where(F.col("_has_target") == 1).select("_k", "_b", "_prior"))
        hit = (same.join(prior, ["_k", "_b"], "left")
               .withColumn("_m", F.coalesce("_same", "_prior")))
    return hit.select(*keep_cols, "_ts", "_m")


MODE_CONF = "touchline.asof.mode"
HEAVY_ROWS = 2_000_000        # rows of one key in one time bucket that a task is given at most
SMALL_BYTES = 256 << 20       # inputs below this can't hold a group too large for a task


def choose_mode(inputs: list[tuple[DataFrame, list[str], str]], lookback_days: int, heavy_rows: int = HEAVY_ROWS,
                small_bytes: int = SMALL_BYTES, sized_by: list[DataFrame] | None = None) -> str | None:
    """The form whose tasks stay small, by the rows of the largest key: ``single`` (one window
    a key, nothing is copied) where no key has more than ``heavy_rows``, None (the default, by time
    buckets) where none has so many in one bucket, else ``range``. ``inputs`` are frames with their key
    columns and time column. Inputs that the planner estimates below ``small_bytes`` aren't
    counted: no key of theirs can be too large for a task (``sized_by``: frames to estimate by instead,
    as the planner overrates joins). All forms give the same rows."""
    spark = inputs[0][0].sparkSession
    if spark.conf.get(MODE_CONF, None):
        return None
    size = sum(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in sized_by or [df for df, _, _ in inputs])
    if size < small_bytes:
        return "single"
    groups = None
    for df, keys, ts in inputs:
        named = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).cast("string").alias("key")) for k in keys])
        g = df.select(F.explode(named).alias("k"), _bucket(F.col(ts), lookback_days * 24).alias("b")).where("k.key IS NOT NULL")
        groups = g if groups is None else groups.unionByName(g)
    by_key = groups.groupBy("k", "b").agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.sum("n").alias("all"), F.max("n").alias("n"))
    top = by_key.agg(F.max("all").alias("all"), F.max("n").alias("n")).head()
    if (top["all"] or 0) <= heavy_rows:
        return "single"
    return "range" if top["n"] > heavy_rows else None


def _mode(spark, mode: str | None, bucket_hours, lookback_days, forward: bool, carry: bool) -> tuple[str, int | None]:
    """Pick the sweep form. An explicit ``mode`` wins; otherwise the session
    conf ``touchline.asof.mode`` (e.g. ``range`` on clusters where one key
    can dominate even a single lookback window); otherwise by parameters."""
    if bucket_hours == "lookback":
        bucket_hours = lookback_days * 24 if lookback_days else 24
    if mode is None and bucket_hours is not None and not carry:
        mode = spark.conf.get(MODE_CONF, None) or None
        if mode == "replicate" and (forward or lookback_days is None):
            mode = None
    if mode is None:
        if bucket_hours is None:
            mode = "single"
        elif carry or forward or lookback_days is None:
            mode = "carry"
        else:
            mode = "replicate"
    if mode == "replicate" and (forward or lookback_days is None):
        raise ValueError("the replicated form needs a lookback (backward lookups)")
    return mode, bucket_hours


def _lookback(m: Column, t: Column, lookback_days: int | None) -> Column:
    if lookback_days is None:
        return m
    return F.when(m.isNotNull() & (m["ts"] >= t - F.make_dt_interval(days=F.lit(lookback_days))), m)


def asof_last(targets: DataFrame, sources: DataFrame, *, target_key: Column | str,
              target_ts: str, target_id: str, source_key: Column | str, source_ts: str,
              source_tiebreak: list[str], source_cols: list[str], lookback_days: int | None,
              out: str = "match", bucket_hours: int | None | str = "lookback",
              target_tiebreak: list[str] | None = None, forward: bool = False,
              carry: bool = False, mode: str | None = None) -> DataFrame:
    """Return ``targets`` plus a struct column ``out`` (NULL when no match)
    holding ``source_ts``, the tie-break columns and ``source_cols`` of the
    winning source row.

    ``mode``: ``replicate`` (default with a lookback), ``carry`` (time
    buckets of ``bucket_hours``, default without a lookback or with
    ``carry=True``), ``range`` (buckets are range partitions of the sorted
    ``(key, time)`` order — a key is split however many rows it has in any
    time span; costs a sampling pass and a checkpoint) or ``single``
    (``bucket_hours=None``: one window per key).

    ``target_id`` must be unique per target row; targets with a NULL key get
    a per-row sentinel key so they neither match nor pile into one task.
    ``forward=True`` flips the direction: the *earliest* source whose
    position ``(ts, tie-break…)`` is strictly after the target's position
    ``(target_ts, target_tiebreak…)`` (no lookback).
    """
    if forward and (target_tiebreak is None or lookback_days is not None):
        raise ValueError("forward lookups need target_tiebreak and no lookback")
    mode, bucket_hours = _mode(targets.sparkSession, mode, bucket_hours, lookback_days, forward, carry)
    tkey = F.col(target_key) if isinstance(target_key, str) else target_key
    skey = F.col(source_key) if isinstance(source_key, str) else source_key
    tcols = targets.columns
    src_fields = [F.col(source_ts).alias("ts")] + [F.col(c) for c in source_tiebreak] + \
                 [F.col(c) for c in source_cols if c not in source_tiebreak]
    src = (sources.where(skey.isNotNull())
           .select(skey.cast("string").alias("_k"), F.col(source_ts).alias("_ts"),
                   F.lit(0).alias("_kind"), F.struct(*source_tiebreak).alias("_ord"),
                   F.struct(*src_fields).alias("_s"),
                   F.lit(None).cast(targets.select(F.struct(*tcols)).schema[0].dataType).alias("_t")))
    sentinel = F.concat(F.lit("\u0000"), F.col(target_id).cast("string"))
    ord_type = src.schema["_ord"].dataType
    tord = (F.struct(*[F.col(t).cast(f.dataType).alias(f.name) for t, f in zip(target_tiebreak, ord_type.fields)])
            if target_tiebreak else F.lit(None).cast(ord_type))
    tgt = targets.select(F.coalesce(tkey.cast("string"), sentinel).alias("_k"),
                         F.col(target_ts).alias("_ts"), F.lit(1).alias("_kind"),
                         tord.alias("_ord"),
                         F.lit(None).cast(src.schema["_s"].dataType).alias("_s"),
                         F.struct(*tcols).alias("_t"))
    hit = _sweep(src.unionByName(tgt), mode, bucket_hours, lookback_days, forward, ["_t"])
    return hit.select(*[F.col("_t")[c].alias(c) for c in tcols],
                      _lookback(F.col("_m"), F.col("_ts"), lookback_days).alias(out))


def asof_rows(rows: DataFrame, *, key: Column | str, ts: str, is_source: Column, row_id: Column,
              source_tiebreak: list[str], source_cols: list[str], lookback_days: int,
              out: str = "match", bucket_hours: int | None | str = "lookback",
              mode: str | None = None) -> DataFrame:
    """The kernel over ONE frame holding both sources and targets
    (``is_source`` tells them apart), for callers whose sources and targets
    come out of the same upstream plan: the plan is referenced once instead
    of once per side. Returns the target rows with ``out``."""
    mode, bucket_hours = _mode(rows.sparkSession, mode, bucket_hours, lookback_days, False, False)
    k = (F.col(key) if isinstance(key, str) else key).cast("string")
    src = is_source
    rows = rows.where(~src | k.isNotNull())
    fields = [F.col(ts).alias("ts")] + [F.col(c) for c in source_tiebreak] + \
             [F.col(c) for c in source_cols if c not in source_tiebreak]
    both = rows.select("*", F.when(src, k).otherwise(F.coalesce(k, F.concat(F.lit("\u0000"), row_id.cast("string"))))
                       .alias("_k"), F.col(ts).alias("_ts"), F.when(src, F.lit(0)).otherwise(F.lit(1)).alias("_kind"),
                       F.when(src, F.struct(*source_tiebreak)).alias("_ord"), F.when(src, F.struct(*fields)).alias("_s"))
    hit = _sweep(both, mode, bucket_hours, lookback_days, False, rows.columns)
    return hit.select(*rows.columns, _lookback(F.col("_m"), F.col("_ts"), lookback_days).alias(out))
