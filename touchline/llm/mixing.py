"""Mixing sources to target weights by Pareto order sampling.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share the
words of all documents; a target stops at ``max_copies`` times its source's size
and the excess is shared out again by weight, which is the water level below
which no source is full. Within a source a document's expected copies follow its own
inclusion weight (a column of whole numbers; the registered query takes the binary digits of
its size): they are its weight times the source's factor, ``max_copies`` at most, and the
factor is the one with which the source's words meet the target, found from the words of
each weight. Whole copies are certain, the fraction is the chance of one more. Those are drawn
by Pareto order sampling: each document's rank is its random odds over its chance's odds, and
the lowest ranks are taken until their words come nearest to what the source still needs. The
sample's size is thus fixed, its draws follow the unequal chances, and every run draws the same.

The cut in each source's order is found from sums over cells of the rank, first
4096 of them, then 4096 within the one that holds the cut, then over the few
ranks inside it. No source is sorted or gathered, however large; what is
gathered is one row per source, and one per source and distinct weight.

Defined results: a null text has no words; a null weight or one below 1 counts as 1;
rows of one id (or, with a null id, of one text) share one draw; a source without words has
target 0; an empty table gives an empty result; the input's columns travel in a struct.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, row_struct, stored, text_of, unpack, words_of

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = "mix"
CELLS = 4096
BROADCAST_SOURCES = 100_000


def _draw(id_col: str, text_col: str, seed: str) -> Column:
    """A uniform number in (0, 1) from the id's digest."""
    of = F.coalesce(col(id_col).cast("string"), F.concat(F.lit("text:"), text_of(text_col)))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), of)), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / float(2**52)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sources`` (``source, source_size``, one row per source) with ``target``."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights)).cast("long")
    s = sources.withColumn("weight", weight).withColumn("full", max_copies * F.col("source_size"))
    # in the order in which the rising level fills the sources
    filling = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("left", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("full").over(before), F.lit(0)))
    s = s.withColumn("sharing", F.sum("weight").over(after))
    s = s.withColumn("is_full", F.col("full") * F.col("sharing") <= F.col("weight") * F.col("left"))
    first = F.struct(F.col("full") / F.col("weight"), F.col("source").isNull(), "source", "left", "sharing")     # of equal ones the first
    level = F.min(F.when(~F.col("is_full"), first)).over(Window.partitionBy())
    s = s.withColumn("level", level)
    share = (F.col("weight") * F.col("level.left")).cast("double") / F.col("level.sharing").cast("double")
    return s.select("source", "source_size", F.when(F.col("is_full"), F.col("full").cast("double")).otherwise(share).alias("target"))


def binary_digits(size: Column) -> Column:
    """An inclusion weight by length: twice the words, one more."""
    return F.length(F.bin(size)).cast("long")


def factors(classes: DataFrame, per_source: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """``per_source`` (a row a source) with ``factor``, ``cap`` (documents of this weight and more are taken
    ``max_copies`` times) and ``need``, the words that draws must give. ``classes``: ``source, weight, words``."""
    p = per_source.withColumnRenamed("source", "_source")
    c = classes.join(p, classes["source"].eqNullSafe(p["_source"])).drop("_source")
    falling = Window.partitionBy("source").orderBy(F.desc("weight"))                       # as many rows as weights
    c = c.withColumn("above", F.sum("words").over(falling)).withColumn(
        "below", F.coalesce(F.sum(F.col("weight") * F.col("words")).over(falling.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)))
    # where the factor takes a weight to the limit exactly, the source gives so many words
    capped = max_copies * (F.col("above") * F.col("weight") + F.col("below")) <= F.col("target") * F.col("weight")
    c = c.withColumn("capped", capped & (F.col("source_size") > 0))
    by = Window.partitionBy("source")
    c = c.withColumn("full", F.sum(F.when(F.col("capped"), F.col("words")).otherwise(0)).over(by)).withColumn(
        "rest", F.sum(F.when(~F.col("capped"), F.col("weight") * F.col("words")).otherwise(0)).over(by))
    factor = F.when(F.col("rest") > 0, (F.col("target") - max_copies * F.col("full")) / F.col("rest")).otherwise(F.lit(0.0))
    c = c.withColumn("factor", factor)
    whole = F.when(F.col("capped"), F.lit(max_copies)).otherwise(F.floor(F.col("factor") * F.col("weight")))
    got = c.groupBy("source").agg(F.first("factor").alias("factor"), F.min(F.when(F.col("capped"), F.col("weight"))).alias("cap"),
                                  F.sum(F.col("words") * whole).alias("certain"))
    out = p.join(got, got["source"].eqNullSafe(p["_source"])).drop("_source")
    return out.withColumn("need", F.col("target") - F.col("certain")).drop("certain")


def _with_copies(df: DataFrame, max_copies: int) -> DataFrame:
    """``whole`` copies and the ``chance`` of one more, by the row's weight."""
    expected = F.when(F.col("weight") >= F.col("cap"), F.lit(float(max_copies))).otherwise(F.col("factor") * F.col("weight"))
    return df.withColumn("expected", expected).withColumn("whole", F.floor("expected")).withColumn(
        "chance", F.col("expected") - F.col("whole")).drop("expected")


def _with_rank(df: DataFrame) -> DataFrame:
    """``rank``: Pareto's order, random odds over the chance's odds, mapped to (0, 1)."""
    odds = F.col("draw") * (1 - F.col("chance")) / ((1 - F.col("draw")) * F.col("chance"))
    return df.withColumn("_odds", F.when(F.col("chance") > 0, odds)).withColumn("rank", F.col("_odds") / (1 + F.col("_odds"))).drop("_odds")


def _joined(df: DataFrame, per_source: DataFrame, broadcast_sources: int) -> DataFrame:
    """``df`` with its source's row of a stored table: broadcast if that is small, else shuffled."""
    if per_source.count() <= broadcast_sources:
        per_source = F.broadcast(per_source)
    p = per_source.withColumnRenamed("source", "_source")
    return df.join(p, df["source"].eqNullSafe(p["_source"])).drop("_source")


def _cut_cell(rows: DataFrame, cell: Column) -> DataFrame:
    """For each source the first cell with which the words exceed the need, and the words before it."""
    sums = rows.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words"), F.first("need").alias("need"),
                                                          F.first("taken_before").alias("taken_before"))
    run = F.sum("words").over(Window.partitionBy("source").orderBy("cell")) + F.col("taken_before")
    past = sums.withColumn("cum", run).filter("cum > need")
    return past.groupBy("source").agg(F.min(F.struct("cell", (F.col("cum") - F.col("words")).alias("taken_before"))).alias("m")).select(
        "source", F.col("m.cell").alias("cut_cell"), F.col("m.taken_before").alias("cell_before"))


def _cuts(rows: DataFrame, broadcast_sources: int) -> DataFrame:
    """``source, cut``: ranks up to the cut are taken; a source of which all are taken has no row."""
    cell = lambda n: F.floor(F.col("rank") * float(n))
    rows = rows.filter("chance > 0").withColumn("taken_before", F.lit(0).cast("long"))
    for n in (CELLS, CELLS * CELLS):
        at = stored(_cut_cell(rows, cell(n)), "cut_cells")
        rows = _joined(rows.drop("taken_before"), at, broadcast_sources).filter(cell(n) == F.col("cut_cell")).withColumn(
            "taken_before", F.col("cell_before")).drop("cut_cell", "cell_before")
    ranks = rows.groupBy("source", "rank").agg(F.sum("size").alias("words"), F.first("need").alias("need"),
                                               F.first("taken_before").alias("taken_before"))
    run = F.sum("words").over(Window.partitionBy("source").orderBy("rank")) + F.col("taken_before")
    ranks = ranks.withColumn("cum", run)
    taken = (F.col("cum") <= F.col("need")) | (F.col("cum") - F.col("need") < F.col("need") - (F.col("cum") - F.col("words")))
    # where none of the cut cell's ranks is taken, the cut lies just below the first
    return ranks.groupBy("source").agg(F.max(F.when(taken, F.col("rank"))).alias("last"), F.min("rank").alias("first")).select(
        "source", F.coalesce("last", F.col("first") - 1e-15).alias("cut"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED,
        carry: dict[str, Column] | None = None, broadcast_sources: int = BROADCAST_SOURCES,
        weight: Callable[[Column], Column] = binary_digits) -> DataFrame:
    """One row per input row: the ``carry`` columns, ``size``, ``source_size``, ``target`` and ``copies``.
    ``weight`` gives the inclusion weight from the size; it may use the columns of ``docs``."""
    size = F.size(words_of(text_of(text_col))).cast("long")
    own = "_size" + "_" * sum(map(len, docs.columns))      # no column's name
    sized = docs.select("*", size.alias(own)).select(
        F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in (carry or {}).items()]).alias("carry"),
        col(source_col).cast("string").alias("source"), F.col(own).alias("size"),
        F.greatest(F.coalesce(weight(F.col(own)).cast("long"), F.lit(1)), F.lit(1)).alias("weight"),
        _draw(id_col, text_col, seed).alias("draw"))
    narrow = stored(sized.select("source", "size", "weight", "draw"), "sizes")
    classes = stored(narrow.groupBy("source", "weight").agg(F.sum("size").alias("words")), "weights")
    per_source = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_copies)
    per_source = stored(factors(classes, stored(per_source, "targets"), max_copies), "sources")
    cuts = _cuts(_with_rank(_with_copies(_joined(narrow, per_source, broadcast_sources), max_copies)), broadcast_sources)
    cuts = cuts.withColumnRenamed("source", "_source")
    plan = stored(per_source.join(cuts, per_source["source"].eqNullSafe(cuts["_source"]), "left").drop("_source"), "plan")
    out = _with_rank(_with_copies(_joined(sized, plan, broadcast_sources), max_copies))
    more = (F.col("chance") > 0) & (F.col("cut").isNull() | (F.col("rank") <= F.col("cut")))
    return out.select(*[F.col("carry").getField(k).alias(k) for k in carry or {}], "size", "source_size", "target",
                      (F.col("whole") + F.when(more, 1).otherwise(0)).cast("long").alias("copies"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """The mix itself: each input row as often as it is taken, with its own columns."""
    out = mix(docs, id_col, text_col, source_col, carry={"row": row_struct(docs)}, **params)
    out = out.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy"))
    return out.select(*unpack(out, "row", docs.columns))
