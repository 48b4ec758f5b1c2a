"""Exact row numbers over a global order without a single-partition window.

``Window.partitionBy(g).orderBy(k)`` puts a whole group into one task and an
unpartitioned window puts *everything* into one task. ``row_number`` here is
computed instead by:

1. range-partitioning on ``(group…, order…)`` — Spark samples the composite
   key, so a huge group is split across many partitions — and sorting within
   partitions;
2. tagging rows with ``monotonically_increasing_id`` (partition index in the
   upper bits, position in the lower 33 bits);
3. writing that frame as a reliable checkpoint (the shared
   ``spark.checkpoint.dir``), so every later read sees the same partitioning;
4. counting rows per ``(partition, group)`` — one row per partition and
   group, bounded by the partition count times the groups touching each
   partition — and turning the counts into offsets with a window per group
   over that small table;
5. joining the offsets back: ``row_number = offset + position within
   partition − first position of the group in that partition + 1``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

_LOW = (1 << 33) - 1


def global_row_number(df: DataFrame, group_cols: list[str], order_cols: list[str], out: str = "rn",
                      partitions: int | None = None, with_group_size: bool = False) -> DataFrame:
    """Add ``out`` = ``row_number() over (partition by group_cols order by
    order_cols)``; ``order_cols`` must make the order total. With
    ``with_group_size`` also add ``group_size``."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = list(group_cols) + list(order_cols)
    tagged = (df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    pid = F.shiftright("_mid", 33).alias("_pid")
    pos = F.col("_mid").bitwiseAND(F.lit(_LOW))
    stats = tagged.groupBy(*group_cols, pid).agg(F.count(F.lit(1)).alias("_cnt"), F.min(pos).alias("_first"))
    w = Window.partitionBy(*group_cols).orderBy("_pid") if group_cols else Window.orderBy("_pid")
    cols = [*group_cols, "_pid", "_first",
            F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off")]
    if with_group_size:
        cols.append(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                    .alias("group_size"))
    offsets = stats.select(*cols)
    j = tagged.withColumn("_pid", F.shiftright("_mid", 33)).join(offsets, [*group_cols, "_pid"])
    return (j.withColumn(out, F.col("_off") + pos - F.col("_first") + 1)
            .drop("_mid", "_pid", "_first", "_off"))
