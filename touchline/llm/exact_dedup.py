"""Exact dedup by progressive refinement.

A copy must agree in length, then in the hash of a short prefix, then in the
hash of the whole text. The first scan reduces the table to counts per
(length, prefix hash); a row alone in its length is alone there too, so both
levels share one aggregate with map-side combine. Only rows of groups with two
or more members are hashed in full, and only those are shuffled: everything
else passes straight from the scan to the output.

Lengths and prefixes are those of the normalised text: each run of
``[\\x20\\x09-\\x0D]`` is one space.

The surviving groups are written once, so their number is known: up to
``broadcast_groups`` rows (24 bytes each) they are broadcast. Beyond it a bitmap of
fixed size (``FILTER_BITS``, 16 MB) of their hashes is: the scan hashes in full only rows whose
key is in it, and those meet the groups by shuffle, as keys and digests.
So are the groups of equal texts (a quarter as many, of 110 bytes). Between two
plain tables a join's skewed partitions are split, so a group of copies with a
third of all rows is never one task's.

Defined results: a null text equals the empty text; a null id is never the one
kept while the group has another, and in a group of null ids alone ``keep_id``
is null and the rows stay; rows that repeat an id and a text share one verdict;
an empty table gives an empty result; the input's columns travel in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, row_struct, stored, text_of, unpack

PREFIX_CHARS = 256
BROADCAST_GROUPS = 1_000_000
BITMAP = 1 << 15             # bits of one of Spark's bitmaps
FILTER_BITS = 4096 * BITMAP


def normalised(text: Column) -> Column:
    """Each white-space run as one space; single spaces, the usual case, are left alone."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def full_hash(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def _maybe(keyed: DataFrame, survivors: DataFrame) -> DataFrame:
    """``keyed`` with ``maybe``: whether its length and prefix can be a survivor's, by a bitmap of fixed size."""
    place = F.pmod(F.xxhash64("len", "pre"), F.lit(FILTER_BITS))
    bucket, bit = F.floor(place / BITMAP), place % BITMAP
    bits = stored(survivors.select(bucket.alias("bucket"), bit.alias("bit")).groupBy("bucket").agg(
        F.bitmap_construct_agg("bit").alias("bits")), "bitmap")                # at most FILTER_BITS / BITMAP rows
    byte = F.conv(F.hex(F.substring("bits", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    out = keyed.withColumn("bucket", bucket).withColumn("_bit", bit).join(F.broadcast(bits), "bucket", "left")
    is_set = F.expr("shiftright(_byte, cast(_bit % 8 AS int))").bitwiseAND(F.lit(1)) == 1
    return out.withColumn("_byte", byte).withColumn("maybe", F.coalesce(is_set, F.lit(False))).drop("bucket", "bits", "_bit", "_byte")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 carry: dict[str, Column] | None = None, prefix_chars: int = PREFIX_CHARS,
                 broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """One row per input row: the ``carry`` columns (expressions over ``docs``),
    ``id``, ``keep_id`` (least id of the equal texts), ``group_size`` and ``kept``."""
    carry = {} if carry is None else carry
    norm = normalised(text_of(text_col))
    keyed = docs.select(F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in carry.items()]).alias("carry"),
                        col(id_col).alias("id"), norm.alias("norm"))
    keyed = keyed.select("carry", "id", "norm", F.length("norm").alias("len"),
                         F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("pre"))

    survivors = stored(keyed.groupBy("len", "pre").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("len", "pre"),
                       "length_prefix_groups")
    small = survivors.count() <= broadcast_groups
    if small:
        groups_of = F.broadcast(survivors)
        candidates = keyed.join(groups_of, ["len", "pre"], "left_semi").select(
            "carry", "id", "len", "pre", full_hash(F.col("norm")).alias("full"))
        alone = keyed.join(groups_of, ["len", "pre"], "left_anti")
    else:
        full = F.when(F.col("maybe"), full_hash(F.col("norm")))
        hashed = _maybe(keyed, survivors).select("carry", "id", "len", "pre", full.alias("full"))
        read = hashed.filter("full IS NOT NULL")
        candidates = read.join(survivors, ["len", "pre"], "left_semi")
        alone = read.join(survivors, ["len", "pre"], "left_anti").unionByName(hashed.filter("full IS NULL"))

    groups = candidates.groupBy("len", "pre", "full").agg(
        F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # a table of its own, so that the rows of a large group meet it by broadcast or in a join that is split
    copies = stored(groups.filter("group_size > 1"), "copies")
    if copies.count() <= broadcast_groups // 4:
        copies = F.broadcast(copies)
    joined = candidates.join(copies, ["len", "pre", "full"], "left")
    out = joined.select("carry", "id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
                        F.coalesce("group_size", F.lit(1)).alias("group_size"))
    out = out.unionByName(alone.select("carry", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")))
    return out.select(*[F.col("carry").getField(k).alias(k) for k in carry], "id", "keep_id", "group_size",
                      F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, with their own columns; of rows that repeat the kept id
    and text, one stays."""
    out = exact_groups(docs, id_col, text_col, carry={"row": row_struct(docs), "digest": full_hash(normalised(text_of(text_col)))}).filter("kept")
    alone, several = out.filter("group_size = 1"), out.filter("group_size > 1")
    once = several.dropDuplicates(["keep_id", "digest"])
    out = alone.select("row").unionByName(once.select("row"))
    return out.select(*unpack(out, "row", docs.columns))
