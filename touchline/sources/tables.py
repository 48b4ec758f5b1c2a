"""Reading and writing the stored model tables.

Product events are stored partitioned by ``app`` and ``event_month`` (the
half-open calendar month in the business zone, U6). A day-window filter on
``occurred_at`` prunes row groups but not partitions — Spark cannot derive
the month from a timestamp predicate — so ``read_events`` adds the matching
``event_month`` values itself and the scan only lists those directories.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import day_window
from ..operators.ingest import assign_event_month, retained_months
from .batches import names, remove

BUSINESS_ZONE = "Asia/Kolkata"


def months_between(day_from: str, day_to: str) -> list[str]:
    """``yyyy_MM`` of every month, in any zone, that a UTC day window can touch:
    zones differ from UTC by less than a day, so one day is added on both sides."""
    d0 = dt.date.fromisoformat(day_from) - dt.timedelta(days=1)
    d1 = dt.date.fromisoformat(day_to) + dt.timedelta(days=1)
    out, y, m = [], d0.year, d0.month
    while (y, m) <= (d1.year, d1.month):
        out.append(f"{y:04d}_{m:02d}")
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return out


def write_events(events: DataFrame, path: str, zone: str = BUSINESS_ZONE) -> None:
    """Append events partitioned by ``app`` and ``event_month``."""
    (events.withColumn("event_month", assign_event_month(F.col("occurred_at"), zone))
     .write.mode("append").partitionBy("app", "event_month").parquet(path))


def read_events(spark: SparkSession, path: str, app: str, day_from: str, day_to: str) -> DataFrame:
    """Events of ``app`` in the day window, reading only the partitions that
    can hold them (partition filters on ``app`` and ``event_month``, row-group
    filters on ``occurred_at``)."""
    return (spark.read.parquet(path)
            .where((F.col("app") == app) & F.col("event_month").isin(*months_between(day_from, day_to))
                   & day_window("occurred_at", day_from, day_to)))


def event_month_folders(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """``(folder, yyyy_MM)`` of the stored months, by their names alone; a table of merged
    batches has them inside each part. Other names are left alone."""
    tops = [path.rstrip("/")]
    tops += [f"{tops[0]}/{n}" for n in names(spark, path) if re.fullmatch(r"(batch_id|run)=[-0-9_]+", n)]
    found = []
    for top in tops:
        for app in [n for n in names(spark, top) if n.startswith("app=")]:
            found += [(f"{top}/{app}/{n}", n[-7:]) for n in names(spark, f"{top}/{app}") if re.fullmatch(r"event_month=\d{4}_\d{2}", n)]
    return found


def drop_event_months(spark: SparkSession, path: str, now: str, months: int = 13) -> list[tuple[str, str]]:
    """Remove the folders of the months that are not retained as of ``now``; no event
    file is opened. Returns what was removed. Kept folders are not touched."""
    keep = set(retained_months(now, months))
    gone = [(folder, month) for folder, month in event_month_folders(spark, path) if month not in keep]
    for folder, _ in gone:
        remove(spark, folder)
    return gone
