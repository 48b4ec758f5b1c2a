"""Hard negatives for every anchor and positive, by search in an STR-packed R-tree.

Components become integers ``floor(scale * x)``; a score is the inner product of two such
vectors, so scores and their ties are exact.

1. The usable rows are stored with a number each. Each label's rows are dealt into tiles
   of about ``tile_rows`` by sort-tile-recursive cuts: along the three coordinates of the
   greatest variance in turn, at quantiles found from counts in 4096 cells of the
   coordinate's range, so no label or slab is sorted or gathered. Rows that no cut
   separates (copies) are dealt out by hash.
2. A tile's rows are put in leaves, again sort-tile-recursive, in a task of their own.
   Tiles of one label that lie together form groups.
3. Anchors, in parts of a bounded number, meet the groups of their own label; each such
   pair is a task that searches the group's boxes best first for the anchor's positives.
   The few rows from each group are merged by anchor.
4. The same with the groups of the other labels for the negatives: a box is skipped where
   its interval misses all of the anchor's score windows, or lies strictly below the
   last row kept of each. The few rows from each group are merged by anchor and positive.

Every row can be reached by every anchor, nothing is capped, and a task holds one group
and one part of the anchors.

Defined results: rows with a null label, a null vector, or any null or non-finite
component take no part, nor do vectors of another length than most (of lengths equally
frequent, the longest). A null id is no anchor, isn't relabelled, and comes after all
others among ties. Rows that repeat an id are rows of their own, and each is an anchor
where the id is one. A negative positive score leaves no window. Components beyond 64
bits take the last value; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, stored, with_package
from .rtree import Best, Tree, Windows, str_order
from .whitening import integers, usable

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95              # percent of the positive's score
TILE_ROWS = 512
LEVELS, CELLS = 3, 4096
GROUP_ROWS = (2048, 65536)      # least and most rows of a group; between them a 64th of the table
ANCHORS_A_TASK = 16384
BUCKETS = 64                    # in which anchors meet the list of groups
BROADCAST_ROWS = 200_000        # rows of cuts, tiles or groups (some 100 bytes each) up to which they are broadcast
NO_ID = (1 << 63) - 1


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, relabel_every: int | None, n_labels: int) -> DataFrame:
    """The usable rows ``uid, id, label, q``, stored."""
    rows = vectors.select(col(id_col).cast("long").alias("id"), col(label_col).cast("long").alias("label"), col(vector_col).alias("v"))
    rows = rows.filter(F.col("label").isNotNull() & usable(F.col("v")))
    if relabel_every:
        moved = (F.col("id") % relabel_every) == 0
        rows = rows.withColumn("label", F.when(moved, (F.col("label") + 1) % n_labels).otherwise(F.col("label")))
    rows = rows.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "label", integers(F.col("v"), scale).alias("q"))
    lengths = rows.groupBy(F.size("q").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.filter(F.size("q") == (lengths["d"] if lengths else 0))
    return stored(rows.select(F.monotonically_increasing_id().alias("uid"), "id", "label", "q"), "rows")


def _few(df: DataFrame, bound: int) -> DataFrame:
    """A stored table, broadcast if it is small."""
    return F.broadcast(df) if df.count() <= bound else df


def tiled(rows: DataFrame, tile_rows: int = TILE_ROWS, levels: int = LEVELS, cells: int = CELLS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with ``path`` and ``piece``: with the label, the tile of a row. Paths follow the cuts' order."""
    spread = rows.select(F.posexplode("q").alias("dim", "c")).groupBy("dim").agg(
        F.var_pop(F.col("c").cast("double")).alias("var"), F.min("c").cast("double").alias("lo"), F.max("c").cast("double").alias("hi"))
    dims = spread.orderBy(F.desc("var"), "dim").limit(levels).collect()
    out = rows.withColumn("path", F.lit(0).cast("long"))
    # slabs a level for each label: the root of its number of tiles
    slabs = F.ceil(F.pow(F.col("total") / tile_rows, F.lit(1.0 / max(1, len(dims)))) - 1e-9)
    labels = stored(rows.groupBy("label").agg(F.count(F.lit(1)).alias("total")).select("label", slabs.cast("long").alias("slabs")), "labels")
    out = out.join(_few(labels, broadcast_rows), "label")
    for r in dims:
        cell = F.floor((F.get("q", F.lit(r["dim"])).cast("double") - r["lo"]) / max(1.0, (r["hi"] - r["lo"] + 1) / cells))
        out = out.withColumn("cell", cell)
        counts = out.filter("slabs > 1").groupBy("label", "path", "slabs", "cell").agg(F.count(F.lit(1)).alias("n"))
        slab = Window.partitionBy("label", "path")          # at most ``cells`` rows
        before = F.sum("n").over(slab.orderBy("cell")) - F.col("n")
        counts = counts.withColumn("slab", F.floor(before * F.col("slabs") / F.sum("n").over(slab)))
        firsts = counts.groupBy("label", "path", "slab").agg(F.min("cell").alias("first"))
        cuts = stored(firsts.groupBy("label", "path").agg(F.collect_list(F.struct("first", "slab")).alias("cuts")), "cuts")   # as many as slabs
        at = F.expr("aggregate(cuts, cast(0 AS bigint), (m, c) -> if(c.first <= cell, greatest(m, c.slab), m))")
        out = out.join(_few(cuts, broadcast_rows), ["label", "path"], "left").withColumn(
            "path", F.col("path") * F.col("slabs") + F.coalesce(at, F.lit(0).cast("long"))).drop("cuts", "cell")
    sizes = stored(out.groupBy("label", "path").agg(F.count(F.lit(1)).alias("n")).filter(f"n > {2 * tile_rows}").select(
        "label", "path", F.ceil(F.col("n") / tile_rows).alias("pieces")), "pieces")
    out = out.join(_few(sizes, broadcast_rows), ["label", "path"], "left")
    return out.withColumn("piece", F.coalesce(F.pmod(F.xxhash64("uid"), F.col("pieces")), F.lit(0).cast("long"))).drop("pieces", "slabs")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)       # of one row at least


def _packed(table: pa.Table) -> pa.Table:
    x = _matrix(table.column("q"))
    order = str_order(x)
    take = pa.array(order)
    return pa.table({
        "label": table.column("label").slice(0, 1), "path": table.column("path").slice(0, 1), "piece": table.column("piece").slice(0, 1),
        "n": pa.array([len(x)], pa.int64()), "ids": pa.array([table.column("id").take(take).to_pylist()], pa.list_(pa.int64())),
        "uids": pa.array([table.column("uid").take(take).to_pylist()], pa.list_(pa.int64())),
        "values": pa.array([x[order].reshape(-1)], pa.list_(pa.int64()))})


def packed(rows: DataFrame, group_rows: tuple[int, int] = GROUP_ROWS, n_rows: int | None = None, **params) -> DataFrame:
    """The tiles, one row each: ``label, path, piece, n, ids, uids, values`` (flat) and ``part``, the number of
    the tile's group within its label."""
    size = min(group_rows[1], max(group_rows[0], (rows.count() if n_rows is None else n_rows) // 64))
    schema = "label long, path long, piece long, n long, ids array<long>, uids array<long>, values array<long>"
    tiles = stored(tiled(rows, **params).groupBy("label", "path", "piece").applyInArrow(_packed, schema), "tiles")
    # one narrow row a tile
    before = F.sum("n").over(Window.partitionBy("label").orderBy("path", "piece")) - F.col("n")
    groups = stored(tiles.select("label", "path", "piece", "n").withColumn("part", F.floor(before / size)).drop("n"), "groups")
    return stored(tiles.join(_few(groups, params.get("broadcast_rows", BROADCAST_ROWS)), ["label", "path", "piece"]), "grouped")


def _tree(tiles: pa.Table) -> Tree:
    rows = tiles.select(["path", "piece", "ids", "uids", "values"]).sort_by([("path", "ascending"), ("piece", "ascending")])
    of = lambda name, k: rows.column(name)[k].values.to_numpy(zero_copy_only=False)
    return Tree([(of("values", k).reshape(len(of("ids", k)), -1), of("ids", k), of("uids", k)) for k in range(len(rows))])


def _find_positives(k: int):
    def run(tiles: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if len(tiles) and len(anchors):
            uids = anchors.column("uid").to_pylist()
            states = [Best(k, own=u) for u in uids]
            _tree(tiles).search(_matrix(anchors.column("q")), states)
            out = [(u, s, i, w) for u, state in zip(uids, states) for s, i, w in state.rows]
        return _columns(out, ("uid", "score", "id", "row"))
    return run


def _find_negatives(k: int, low: int, high: int):
    def run(tiles: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if len(tiles) and len(anchors):
            uids, positives = anchors.column("uid").to_pylist(), anchors.column("positives").to_pylist()
            states = [Windows([Best(k, -(-low * p["score"] // 100), high * p["score"] // 100) for p in of]) for of in positives]
            _tree(tiles).search(_matrix(anchors.column("q")), states)
            out = [(u, p["place"], s, i, w) for u, of, state in zip(uids, positives, states)
                   for p, best in zip(of, state.parts) for s, i, w in best.rows]
        return _columns(out, ("uid", "place", "score", "id", "row"))
    return run


def _columns(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    return pa.table({n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(names)})


def _searched(tiles: DataFrame, anchors: DataFrame, function, names: tuple[str, ...], pairs: int) -> DataFrame:
    """``function`` for every group and part of the anchors; each of the ``pairs`` may be a task."""
    keys, tasks = ["label", "part", "share"], max(1, min(pairs, 4096))
    left, right = (x.repartition(tasks, *keys).groupBy(*keys) for x in (tiles, anchors))
    return left.cogroup(right).applyInArrow(lambda t, a: function(t, a), ", ".join(f"{n} long" for n in names))


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor_every: int = 50,
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
         relabel_every: int | None = None, n_labels: int = 10, group_rows: tuple[int, int] = GROUP_ROWS,
         anchors_a_task: int = ANCHORS_A_TASK, broadcast_rows: int = BROADCAST_ROWS, **tiling) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for every anchor, positive and
    negative. With ``relabel_every``, rows whose id it divides first get the label ``(label + 1) % n_labels``."""
    with_package(vectors.sparkSession)
    rows = prepared(vectors, id_col, vector_col, label_col, scale, relabel_every, n_labels)
    tiles = packed(rows, group_rows, broadcast_rows=broadcast_rows, **tiling)
    groups = stored(tiles.select("label", "part").distinct(), "directory")
    anchors = rows.filter((F.col("id") % anchor_every == 0) & (F.col("id") != NO_ID))
    shares = max(1, -(-anchors.count() // anchors_a_task))
    anchors = stored(anchors.withColumn("share", F.pmod(F.xxhash64("uid"), F.lit(shares))), "anchors")
    n_groups = groups.count()
    of_share = stored(tiles.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share")), "tiles") \
        if shares > 1 else tiles.withColumn("share", F.lit(0).cast("long"))
    groups = _few(groups, broadcast_rows)

    near = anchors.join(groups, "label").select("label", "part", "share", "uid", "q")
    found = _searched(of_share, near, _find_positives(positives), ("uid", "score", "id", "row"), n_groups * shares)
    own = _first(found, ["uid"], positives).groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct("place", "score", "id"))).alias("positives"))
    asked = stored(anchors.join(own, "uid"), "asked")

    # every anchor meets every group of another label, by way of buckets of the groups
    bucket = groups.select(F.col("label").alias("other"), "part", F.pmod(F.xxhash64("label", "part"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    far = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("bucket")).join(bucket, "bucket").filter("label <> other")
    far = far.select(F.col("other").alias("label"), "part", "share", "uid", "q", F.expr(
        "transform(positives, p -> named_struct('place', cast(p.place AS bigint), 'score', p.score))").alias("positives"))
    found = _searched(of_share, far, _find_negatives(negatives, low, high), ("uid", "place", "score", "id", "row"), n_groups * shares)
    found = found.withColumnRenamed("place", "positive")
    best = _first(found, ["uid", "positive"], negatives).select("uid", "positive", F.col("place").alias("rank"), F.col("score").alias("negative_score"),
                                                              F.col("id").alias("negative_id"))
    named = asked.select("uid", F.col("id").alias("anchor_id"), F.explode("positives").alias("p")).select(
        "uid", "anchor_id", F.col("p.place").cast("long").alias("positive"), F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    out = named.join(best, ["uid", "positive"])
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")
