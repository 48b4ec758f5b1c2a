"""Hard negatives against brute force; the tree's bounds and order."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import hard_negatives, queries, rtree

SCHEMA = "vec_id long, embedding array<float>, label int"
TINY = {"tile_rows": 8, "cells": 16, "group_rows": (20, 40), "anchors_a_task": 7}


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95, scale=256, relabel=7):
    used = [(i, (y + 1) % 10 if relabel and i is not None and i % relabel == 0 else y, [math.floor(float(np.float32(c)) * scale) for c in v])
            for i, v, y in rows if y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    if used:
        sizes = Counter(len(q) for _, _, q in used)
        d = max(sizes, key=lambda n: (sizes[n], n))
        used = [u for u in used if len(u[2]) == d]
    late = lambda i: (i is None, i or 0)
    out = Counter()
    for a, (i, y, q) in enumerate(used):
        if i is None or i % every:
            continue
        scored = [(sum(x * z for x, z in zip(q, r)), j, l) for b, (j, l, r) in enumerate(used) if b != a]
        scored.sort(key=lambda s: (-s[0], late(s[1])))
        for p, pid, _ in [s for s in scored if s[2] == y][:positives]:
            fits = [s for s in scored if s[2] != y and low * p <= 100 * s[0] <= high * p][:negatives]
            out.update((i, pid, k, s[1], p, s[0]) for k, s in enumerate(fits, 1))
    return out


def run(spark, rows, **params):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("id", "q", "uid", "path", "n", "share", "score", "cell")})
    return Counter(map(tuple, hard_negatives.mine(df, relabel_every=7, **params).collect()))


def cloud(seed, n, d, labels=4, spread=1.0):
    rng = random.Random(seed)
    mid = [[rng.gauss(0, spread) for _ in range(d)] for _ in range(labels)]
    return [(k, [m + rng.gauss(0, 1) for m in mid[k % labels]], k % labels) for k in range(n)]


@pytest.mark.parametrize("params", [{}, TINY, TINY | {"broadcast_rows": 0}])
def test_mining_matches_brute_force(spark, params):
    rows = cloud(1, 700, 5)
    rows += [(k, rows[k][1], rows[k][2]) for k in (0, 50, 50, 101, 102, 103)]              # ids and rows that repeat
    rows += [(5000 + k, rows[3][1], k % 3) for k in range(90)]                                 # many copies of one vector
    rows += [(None, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (None, [1.0, 2.0, 3.0, 4.0, 5.0], 2), (9000, None, 1), (9050, [1.0] * 5, None),
             (9100, [None, 1.0, 1.0, 1.0, 1.0], 1), (9150, [float("nan")] * 5, 1), (9200, [float("inf")] * 5, 1), (9250, [1.0, 2.0], 1), (9300, [], 2),
             (9350, [0.0] * 5, 3), (9400, [-1.0, 0.0, 0.0, 0.0, 0.0], 77)]
    random.Random(2).shuffle(rows)
    assert run(spark, rows, **params) == brute(rows)


def test_tables_without_pairs(spark):
    assert run(spark, []) == Counter()
    assert run(spark, [(0, [1.0], 1)]) == Counter()
    assert run(spark, [(0, [1.0], 1), (1, [2.0], 1)]) == Counter()                             # no row of another label
    assert run(spark, [(1, [1.0], 1), (2, [2.0], 2)]) == Counter()                             # no anchor
    assert run(spark, [(50, [], 1), (51, [], 1), (52, [], 2)]) == brute([(50, [], 1), (51, [], 1), (52, [], 2)])


def test_scores_beyond_doubles_stay_exact(spark):
    rows = [(50 * k, [c * (1 - k % 2 * 0.2) for c in (1e6 + k % 3, -3e6 + k, 2e6)], k % 2) for k in range(12)]
    assert run(spark, rows) == brute(rows) != Counter()
    big = [x * 2**20 for x in range(-3, 4)]
    tree = rtree.Tree([(np.array([[b, 2**40 + b] for b in big]), np.arange(7), np.arange(7))])
    state = rtree.Best(3)
    tree.search(np.array([[2**30 + 1, 2**40 + 7]]), [state])
    want = sorted(((b * (2**30 + 1) + (2**40 + b) * (2**40 + 7), k) for k, b in enumerate(big)), key=lambda s: (-s[0], s[1]))[:3]
    assert [(s, i) for s, i, _ in state.rows] == want


def test_bounds_hold_and_far_boxes_are_not_scored(monkeypatch):
    rng = np.random.default_rng(3)
    tiles = []
    for t in range(6):                                       # tiles far apart, so that most can be left out
        x = rng.integers(-20, 20, (100, 6)) + t * 300
        x = x[rtree.str_order(x)]
        tiles.append((x, np.arange(100) + 100 * t, np.arange(100) + 100 * t))
    tree = rtree.Tree(tiles)
    q = rng.integers(-50, 50, (20, 6))
    for (lo, hi), starts in zip(tree.bounds(q), (np.arange(0, 600, 100), tree.starts)):
        s = q @ tree.x.T
        assert (np.minimum.reduceat(s, starts, axis=1) >= lo).all() and (np.maximum.reduceat(s, starts, axis=1) <= hi).all()
    scored = []
    offer = rtree.Best.offer
    monkeypatch.setattr(rtree.Best, "offer", lambda self, s, i, u: (scored.append(len(s)), offer(self, s, i, u)))
    for k, low, high in ((5, None, None), (3, -2000, 2000), (3, 5000, 4000)):
        states = [rtree.Best(k, low, high) for _ in q]
        scored.clear()
        tree.search(q, states)
        for row, state in zip(q @ tree.x.T, states):
            fits = [(int(v), j) for j, v in enumerate(row) if (low is None or v >= low) and (high is None or v <= high)]
            assert [(v, j) for v, j, _ in state.rows] == sorted(fits, key=lambda r: (-r[0], r[1]))[:k]
        assert sum(scored) < 0.6 * q.shape[0] * 600


def test_tiles_hold_every_row_once_and_stay_small(spark):
    rows = cloud(4, 900, 6) + [(10_000 + k, [1.0] * 6, 2) for k in range(500)]
    df = hard_negatives.prepared(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label", 256, None, 10)
    tiles = hard_negatives.packed(df, (64, 64), tile_rows=16).collect()
    assert Counter(i for t in tiles for i in t["ids"]) == Counter(r[0] for r in rows)
    assert max(t["n"] for t in tiles) <= 64 and all(len(t["values"]) == 6 * t["n"] for t in tiles)
    sizes = Counter()
    for t in tiles:
        sizes[t["label"], t["part"]] += t["n"]
    assert max(sizes.values()) <= 64 + 64


def test_registered_query_on_the_larger_table(spark):
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    want = con.execute(queries.ORACLES["op13_hard_negatives"]).fetchall()
    got = queries.QUERIES["op13_hard_negatives"](spark, sf).collect()
    assert Counter(map(tuple, got)) == Counter(want) and len(want) == 600
