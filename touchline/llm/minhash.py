"""Near-dup detection: MinHash banding, signature verification, exact confirmation
on full shingle sets, connected components.

1. One scan gives every text its shingle count, the digest of its shingle set and
   its MinHash signature (32 bands of 4 minima: two sets of similarity 0.75 share
   no band with probability 5e-6).
2. Texts with equal sets are one representative (their least id).
3. The members of a band's bucket are tested against one of them, the most central
   (its buckets hold the most members: among copies with edits, the one nearest to
   their origin), so a bucket of any size gives as many pairs as members. Pairs whose
   signatures agree too little are dropped (half of the minima; a link at similarity
   0.75 has less with probability 3.4e-10), the others are confirmed on the full sets, read again
   only for the texts in question. Components follow from alternating stars.
4. What is left are members of one bucket in different components. In buckets of up
   to 64 members all of them are compared. Larger ones are taken in rounds: in each
   the next most central member is tested against the members outside its component,
   until a round finds no further link or a fixed number of rounds is over.
5. The members of large buckets that then still hold several components are joined
   exactly. A link's sets share a shingle near the front of both when each is sorted
   rarest first; how near follows from their sizes. All pairs of different components
   that do are confirmed on their full sets, without a look at their signatures. Any
   one order of the shingles gives the same links; the counts that give it are kept in
   2^20 cells, so that their size is fixed. A shingle in the fronts of many texts is
   a grid of tasks, to whose rows and columns its two sides are dealt.

Nothing is capped or dropped, and no step gathers a bucket, a component or the
links anywhere but in shuffled tables; sets of up to 4,000,000 shingles are broadcast
to the pairs that they confirm.

Defined results: a null text counts as empty; texts without words link with
nothing; rows that repeat an id are judged by their own texts, and where the id
represents several texts their links count together; a null id is linked with
nothing and its component is null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, map_arrow, row_struct, shuffle_tasks, stored, text_of, unpack
from .components import connected_components
from .shingles import WIDTH, MinHash, shingle_sets

BANDS, ROWS = 32, 4
SEED = 7
PERCENT = 75                 # similarity of a link, in percent
SIGNATURE_FLOOR = 0.5        # share of equal minima below which a pair isn't confirmed
SMALL_BUCKET = 64            # members up to which all components of a bucket are compared
BROADCAST_IDS = 2_000_000    # ids (16 bytes each) up to which a filter by id is broadcast
BROADCAST_SHINGLES = 4_000_000   # shingles (8 bytes each) up to which sets are broadcast to the pairs
CELLS = 1 << 20              # cells of the shingle counts that order the sets
HOT_SHINGLE = 512            # texts with a shingle in their fronts that meet in one cell of the join
ROUNDS = 6                   # at most so many rounds of pivots before the exact join of what is left
BATCH_SHINGLES = 1 << 14


def _prints(width: int, minhash: MinHash):
    size = len(minhash.a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, rows = [], [], np.zeros((batch.num_rows, size), np.uint32)
            group: list[tuple[int, np.ndarray]] = []

            def flush():
                if group:
                    rows[[k for k, _ in group]] = minhash.signatures([s for _, s in group])
                    group.clear()
            held = 0
            for k, s in enumerate(shingle_sets(batch.column(1), width)):
                counts.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if len(s):
                    group.append((k, s))
                    held += len(s)
                if held >= BATCH_SHINGLES:
                    flush()
                    held = 0
            flush()
            flat = pa.array(rows.view(np.int32).reshape(-1), pa.int32())
            cuts = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()),
                 pa.ListArray.from_arrays(cuts, flat)], names=["id", "n", "key", "sig"])
    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = batch.column(0), list(shingle_sets(batch.column(1), width))
            cuts = np.cumsum([0] + [len(s) for s in sets], dtype=np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))],
                                             names=["id", "shingles"])
    return run


def _fronts(cells: np.ndarray, percent: int):
    """For each set the places and shingles, rarest first, of which a link shares at least one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, places, found = [], [], [], []
            for k, s in enumerate(batch.column(2)):
                s = s.values.to_numpy()
                count = cells[s & (CELLS - 1)]
                order = np.lexsort((s, count))[:len(s) - -(-percent * len(s) // 100) + 1]
                at = np.flatnonzero(count[order] > 1)
                rows.append(np.full(len(at), k))
                sizes.append(np.full(len(at), len(s)))
                places.append(at)
                found.append(s[order[at]])
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), *[pa.array(np.concatenate(c), pa.int64())
                                                                           for c in (sizes, places, found)]],
                    names=["id", "root", "n", "place", "shingle"])
    return run


def _of_ids(df: DataFrame, ids: DataFrame, how: str, broadcast_ids: int) -> DataFrame:
    """``df`` semi- or anti-joined with a stored table of ids: broadcast if that is small, else shuffled."""
    return df.join(F.broadcast(ids) if ids.count() <= broadcast_ids else ids, "id", how)


class _Linker:
    """The links between representatives, and the confirmation of candidate pairs."""

    def __init__(self, texts: DataFrame, reps: DataFrame, width: int, percent: int, floor: float, broadcast_ids: int):
        self.texts, self.reps, self.width, self.percent = texts, reps, width, percent
        self.floor, self.broadcast_ids = floor, broadcast_ids

    def alike(self, pairs: DataFrame) -> DataFrame:
        """The candidate pairs ``a, b`` (with what other columns they have) whose signatures agree enough."""
        sig = self.reps.select(F.col("id"), "sig")
        met = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(
            sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
        same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
        return met.filter(same >= self.floor * F.size("sa")).select(*pairs.columns)

    def sets(self, ids: DataFrame) -> DataFrame:
        """The full shingle sets of the texts of a stored table of ids."""
        sets = map_arrow(_of_ids(self.texts, ids, "left_semi", self.broadcast_ids), _sets(self.width), T.StructType(
            [self.texts.schema["id"], T.StructField("shingles", T.ArrayType(T.LongType()))]))
        return stored(sets, "sets")

    def confirmed(self, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """The pairs (a stored table) that are links by their full shingle sets, read from the texts if not given."""
        if sets is None:
            sets = self.sets(stored(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "ids"))
        met = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b").join(
            sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
        common = F.size(F.array_intersect("sa", "sb"))
        return met.withColumn("common", common).filter(
            100 * F.col("common") >= self.percent * (F.size("sa") + F.size("sb") - F.col("common"))).select(*pairs.columns)


def _buckets(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    key = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)),
                      lambda k: F.xxhash64(k, F.slice("sig", k * rows + 1, F.lit(rows))))
    return reps.select("id", F.explode(key).alias("bucket"))


def _pairs(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's pivot, once."""
    met = members.join(pivots, "bucket").filter("id <> pivot")
    return met.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def _central(members: DataFrame) -> DataFrame:
    """Each bucket's most central member: the one whose buckets hold the most members,
    which in a group of copies is the one nearest to their common origin; of several
    such the least id."""
    return members.groupBy("bucket").agg(F.min_by("id", F.struct(-F.col("score"), F.col("id"))).alias("pivot"))


def _mixed(members: DataFrame) -> DataFrame:
    """Members ``bucket, id, root`` of the buckets that hold more than one component, with the bucket's size."""
    several = members.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                            F.count(F.lit(1)).alias("members")).filter("lo <> hi").select("bucket", "members")
    return members.join(stored(several, "several"), "bucket")


def _ordered(met: DataFrame) -> DataFrame:
    """Pairs ``id, other`` with their components as ``a < b`` and ``ra, rb``."""
    first = F.col("id") < F.col("other")
    return met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"),
                      F.when(first, F.col("root")).otherwise(F.col("other_root")).alias("ra"),
                      F.when(first, F.col("other_root")).otherwise(F.col("root")).alias("rb"))


def _across(members: DataFrame) -> DataFrame:
    """All pairs of different components within small buckets."""
    y = members.select("bucket", F.col("id").alias("other"), F.col("root").alias("other_root"))
    return _ordered(members.select("bucket", "id", "root").join(y, "bucket").filter("id < other AND root <> other_root"))


def _star_round(members: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of large buckets with the next most central member as pivot, where
    their components differ; and the pivots used so far, one row per bucket and round."""
    fresh = members.join(used, ["bucket", "id"], "left_anti")
    pivots = stored(fresh.groupBy("bucket").agg(F.min_by(
        F.struct(F.col("id").alias("other"), F.col("root").alias("other_root")),
        F.struct(-F.col("score"), F.col("id"))).alias("p")).select("bucket", "p.*"), "pivots")
    pairs = _ordered(members.select("bucket", "id", "root").join(pivots, "bucket").filter("root <> other_root"))
    return pairs, used.unionByName(pivots.select("bucket", F.col("other").alias("id")))


def _moved(df: DataFrame, merged: DataFrame) -> DataFrame:
    """``df`` with ``root`` replaced where components were merged."""
    to = merged.select(F.col("leaf").alias("root"), F.col("root").alias("to"))
    return df.join(to, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")


def _front_pairs(sets: DataFrame, percent: int, hot: int) -> DataFrame:
    """All pairs of different components among ``id, root, shingles`` (a stored table) whose
    sets can be links: sizes ``n <= m`` need ``ceil(percent (n + m) / (100 + percent))``
    common shingles, so the first common one stands at most that far from the end of both."""
    counts = sets.select(F.explode("shingles").alias("s")).groupBy(F.col("s").bitwiseAND(F.lit(CELLS - 1)).alias("cell")).agg(
        F.count(F.lit(1)).alias("c")).toArrow()
    cells = np.zeros(CELLS, np.int64)
    cells[counts.column("cell").to_numpy()] = counts.column("c").to_numpy()
    schema = T.StructType([sets.schema["id"], sets.schema["root"],
                           *[T.StructField(c, T.LongType()) for c in ("n", "place", "shingle")]])
    fronts = stored(map_arrow(sets.select("id", "root", "shingles"), _fronts(cells, percent), schema), "fronts")
    often = stored(fronts.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "often")
    fronts = stored(fronts.join(often, "shingle").withColumn("parts", F.ceil(F.col("c") / hot)).drop("c"), "fronts")

    # the larger set meets the smaller one's shorter front; both sides of a shingle of many fronts
    # are dealt to the rows and columns of a grid, whose cells are the tasks
    tasks = shuffle_tasks(sets.sparkSession)
    own, every = F.pmod(F.xxhash64("id"), F.col("parts")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    one = fronts.withColumn("part", own).withColumn("part_of_other", every).repartition(tasks, "shingle", "part", "part_of_other")
    two = fronts.filter(f"place <= n - ({2 * percent} * n + {99 + percent}) div {100 + percent}").select(
        "shingle", F.col("id").alias("other"), F.col("root").alias("other_root"), F.col("n").alias("m"),
        F.col("place").alias("other_place"), own.alias("part_of_other"), every.alias("part"))
    two = two.repartition(tasks, "shingle", "part", "part_of_other")
    need = f"({percent} * (n + m) + {99 + percent}) div {100 + percent}"
    met = one.join(two.hint("merge"), ["shingle", "part", "part_of_other"]).filter("root <> other_root").filter(
        f"(m < n OR m = n AND other < id) AND 100 * m >= {percent} * n").filter(
        f"place <= n - {need} AND other_place <= m - {need}")
    return _ordered(met).distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                    bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT, floor: float = SIGNATURE_FLOOR,
                    small_bucket: int = SMALL_BUCKET, broadcast_ids: int = BROADCAST_IDS, seed: int = SEED,
                    broadcast_shingles: int = BROADCAST_SHINGLES, hot_shingle: int = HOT_SHINGLE, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id, kept``."""
    texts = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    schema = T.StructType([texts.schema["id"], T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()),
                           T.StructField("sig", T.ArrayType(T.IntegerType()))])
    prints = stored(map_arrow(texts, _prints(width, MinHash(bands * rows, seed)), schema), "prints")
    sets = prints.filter("n > 0 AND id IS NOT NULL")
    reps = stored(sets.groupBy("key").agg(F.min("id").alias("id"), F.first("sig").alias("sig")), "representatives")
    linker = _Linker(texts.filter("id IS NOT NULL"), reps, width, percent, floor, broadcast_ids)

    members = _buckets(reps, bands, rows)
    # what is joined to the members of a bucket is a table of its own: a join of two plain tables is split where it is skewed
    shared = stored(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "shared")
    members = stored(members.join(shared, "bucket"), "members")
    score = members.groupBy("id").agg(F.sum("c").alias("score"))
    members = stored(members.select("id", "bucket").join(score, "id"), "members")
    central = stored(_central(members), "central")
    pairs = stored(linker.alike(_pairs(members, central)), "pairs")
    stars = connected_components(linker.confirmed(pairs))

    rest = stored(members.select("bucket", "id", "score").join(stars.select(F.col("leaf").alias("id"), "root"), "id", "left").withColumn(
        "root", F.coalesce("root", "id")), "rest")
    used = central.withColumnRenamed("pivot", "id")
    for turn in range(rounds + 1):
        mixed = stored(_mixed(rest), "mixed")
        large = mixed.filter(F.col("members") > small_bucket)
        if turn == rounds or turn and large.isEmpty():
            break
        pairs, used = _star_round(large, used)
        if turn == 0:
            pairs = pairs.unionByName(_across(mixed.filter(F.col("members") <= small_bucket)))
        pairs = stored(linker.alike(pairs.distinct()), "pairs")
        merged = connected_components(linker.confirmed(pairs), "ra", "rb")
        if merged.isEmpty():
            break
        stars = stored(_moved(stars, merged).unionByName(merged), "stars")
        rest = stored(_moved(large.select("bucket", "id", "score", "root"), merged), "rest")

    if not large.isEmpty():
        left = stored(large.select("id", "root").distinct(), "left")
        full = stored(linker.sets(stored(left.select("id"), "ids")).dropDuplicates(["id", "shingles"]).join(left, "id"), "full")
        pairs, full_sets = stored(_front_pairs(full, percent, hot_shingle), "pairs"), full.select("id", "shingles")
        if full.agg(F.sum(F.size("shingles"))).first()[0] <= broadcast_shingles:
            pairs, full_sets = pairs.repartition(shuffle_tasks(docs.sparkSession)), F.broadcast(full_sets)
        merged = connected_components(linker.confirmed(pairs, full_sets), "ra", "rb")
        stars = stored(_moved(stars, merged).unionByName(merged), "stars")

    of_key = reps.select("key", F.col("id").alias("rep")).join(
        stars.select(F.col("leaf").alias("rep"), "root"), "rep", "left").select("key", F.coalesce("root", "rep").alias("component"))
    linked = sets.select("id", "n", "key").join(of_key, "key").select("id", "n", "component")
    alone = prints.filter("NOT (n > 0 AND id IS NOT NULL)").select("id", "n", F.col("id").alias("component"))
    return linked.unionByName(alone).select(
        "id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     broadcast_ids: int = BROADCAST_IDS, **params) -> DataFrame:
    """The input rows of which one stays for each component, with their own columns: the
    one of the least id (null last), of rows that repeat it any one. Rows are linked by
    their texts alone, known by their digests, so one id on several texts is several
    documents; texts without words all stay."""
    id_, node = col(id_col).alias("id"), F.unhex(F.md5(text_of(text_col).cast("binary"))).alias("node")
    found = stored(near_components(docs.select(node, col(text_col).cast("string").alias("text")), "node", "text",
                                   broadcast_ids=broadcast_ids, **params).filter("n_shingles > 0"), "components")
    several = stored(found.groupBy("component_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "several")
    of_node = stored(found.groupBy("id", "component_id").agg(F.count(F.lit(1)).alias("copies")).join(several, "component_id").select(
        F.col("id").alias("node"), F.col("component_id").alias("component"), "copies"), "nodes")
    few = F.broadcast if of_node.count() <= broadcast_ids else lambda x: x
    rows = docs.select(id_, node).join(few(of_node), "node")
    stays = stored(rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "node")).alias("m")).select(
        F.col("m.node").alias("stays"), F.col("m.id").alias("keep_id"), "component"), "stays")
    verdict = stored(of_node.join(stays, "component").select(
        "node", "keep_id", F.when(F.col("node") != F.col("stays"), "drop").when(F.col("copies") > 1, "one").otherwise("keep").alias("verdict")
    ).filter("verdict <> 'keep'"), "verdicts")
    packed = docs.select(id_, node, row_struct(docs).alias("row"))
    out = packed.join(few(verdict.select("node")), "node", "left_anti").select("row")
    once = verdict.filter("verdict = 'one'").select("node", "keep_id")
    if not once.isEmpty():                                # the text that stays is on several rows
        again = packed.join(few(once), "node").filter(F.col("id").eqNullSafe(F.col("keep_id")))
        out = out.unionByName(again.groupBy("node").agg(F.first("row").alias("row")).select("row"))
    return out.select(*unpack(out, "row", docs.columns))
