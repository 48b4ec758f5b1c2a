"""Connected components by alternating large-star and small-star.

Every round keeps one row per edge and groups with map-side minima, so a node
with a third of all edges costs no task more than its share: its edges meet its
minimum in a join that is split where it is skewed, as it can be between two
plain tables. Each round's edges and minima are tables in the shared checkpoint
folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("leaf").alias("u"), F.col("root").alias("v")).unionByName(
        e.select(F.col("root").alias("u"), F.col("leaf").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = stored(least, "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("leaf"), F.col("m").alias("root")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = stored(e.groupBy("leaf").agg(F.min("root").alias("m")), "least")
    met = e.join(least, "leaf")
    return met.filter("root > m").select(F.col("root").alias("leaf"), F.col("m").alias("root")).unionByName(
        least.select("leaf", F.col("m").alias("root"))).distinct()


def _is_forest_of_stars(e: DataFrame) -> bool:
    """No leaf has two roots and no root is a leaf."""
    ends = e.select(F.col("leaf").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        e.select(F.col("root").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter(
        "up > 1 OR (up > 0 AND down > 0)").isEmpty()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``leaf, root`` for every node that isn't the least of its component; loops and
    nulls are ignored, repeated links count once."""
    e = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("leaf"), F.least(a, b).alias("root")).distinct()
    e = stored(e, "links")
    while not _is_forest_of_stars(e):
        e = stored(_small_star(_large_star(e)), "stars")
    return e
