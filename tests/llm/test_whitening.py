"""Whitening against Jacobi rotations in decimal arithmetic."""

import math
import random
from collections import Counter
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import charpoly, queries, whitening

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def jacobi(m):
    """Eigenvalues and vectors (columns) of a symmetric matrix of integers."""
    with localcontext() as ctx:
        ctx.prec = 60
        d = len(m)
        a = [[Decimal(int(x)) for x in row] for row in m]
        v = [[Decimal(int(i == j)) for j in range(d)] for i in range(d)]
        for _ in range(60):
            off = sum(a[i][j] ** 2 for i in range(d) for j in range(i))
            if off < Decimal(10) ** -70:
                break
            for p in range(d):
                for q in range(p + 1, d):
                    if a[p][q] == 0:
                        continue
                    h = (a[q][q] - a[p][p]) / (2 * a[p][q])
                    t = (1 if h >= 0 else -1) / (abs(h) + (h * h + 1).sqrt())
                    c = 1 / (t * t + 1).sqrt()
                    s = t * c
                    for row in (*a, *v):
                        row[p], row[q] = c * row[p] - s * row[q], s * row[p] + c * row[q]
                    a[p], a[q] = [c * x - s * y for x, y in zip(a[p], a[q])], [s * x + c * y for x, y in zip(a[p], a[q])]
        order = sorted(range(d), key=lambda i: -a[i][i])
        return [a[i][i] for i in order], [[v[r][i] for r in range(d)] for i in order]


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, components=16, scale=64):
    """By (id, place): deviation and the size of each whitened value; explained by component."""
    x = {k: [math.floor(np.float64(np.float32(c)) * scale) + 1_000_000 for c in v] for k, v in enumerate(rows) if good(v)}
    fit = [list(t) for t in set(map(tuple, x.values()))]
    n, d = len(fit), len(fit[0])
    s = [sum(r[i] for r in fit) for i in range(d)]
    m = [[n * sum(r[i] * r[j] for r in fit) - s[i] * s[j] for j in range(d)] for i in range(d)]
    values, vectors = jacobi(m)
    trace, out = sum(m[i][i] for i in range(d)), {}
    keep = [k for k in range(min(components, d)) if values[k] > Decimal(10) ** -20]
    with localcontext() as ctx:
        ctx.prec = 60
        for k, v in x.items():
            z = [n * c - t for c, t in zip(v, s)]
            out[k] = sum(c * c for c in z), [float(sum(a * b for a, b in zip(z, vectors[j])) / values[j].sqrt()) for j in keep]
    return n, out, [float(values[j] / trace) for j in keep]


def gathered(df):
    by = {}
    for r in df.collect():
        by.setdefault(r["k"], {})[r["component"]] = r
    return by


def compare(rows, got, components=16, rtol=1e-11):
    n, want, explained = brute(rows, components)
    assert got.keys() == want.keys()
    flat = {}
    for k, (deviation, whitened) in want.items():
        assert sorted(got[k]) == list(range(1, len(explained) + 1))
        for j, r in got[k].items():
            assert (r["n"], r["deviation"]) == (n, deviation) and math.isclose(r["explained"], explained[j - 1], rel_tol=1e-12)
            assert r["identity_error"] < 1e-8
            flat.setdefault(j, []).append((r["whitened"], whitened[j - 1]))
    for pairs in flat.values():
        sign = 1 if sum(a * b for a, b in pairs) > 0 else -1
        assert all(abs(a - sign * b) < rtol * max(1, abs(b)) for a, b in pairs)


def frame(spark, rows):
    return spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "vec_id long, embedding array<float>").withColumns(
        {c: F.lit("own") for c in ("k", "x", "v", "n", "carry", "component", "whitened", "deviation")})


def run(df, **params):
    return whitening.whiten(df, carry={"k": F.col("vec_id")}, **params)


def cloud(seed, n, d):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.linspace(3, 0.4, d) + rng.normal(size=d) * 50).tolist()


@pytest.mark.parametrize("n, d, components", [(300, 6, 16), (300, 6, 3), (40, 20, 16), (4, 9, 16)])
def test_whitening_matches_jacobi(spark, n, d, components):
    rows = cloud(n + d, n, d)
    rows += rows[:50] + [None, [None] + [1.0] * (d - 1), [float("nan")] + [0.0] * (d - 1), [float("inf")] * d]
    compare(rows, gathered(run(frame(spark, rows), components=components)), components)


def test_close_eigenvalues_keep_their_vectors(spark):
    """Two eigenvalues that agree to nine digits: the vectors follow from exact sums only."""
    rng = random.Random(3)
    rows = [[float(s * (1 << 15)), 0.0, float(rng.randrange(3))] for s in (1, -1)] * 3 + [[0.0, float(s * (1 << 15)), 0.0] for s in (1, -1)] * 2
    rows += [[1.0, 2.0, 0.0], [3.0, 1.0, 7.0]]
    compare(rows, gathered(run(frame(spark, rows))), rtol=1e-9)


def test_repeated_eigenvalues_and_flat_tables(spark):
    d = 4
    cross = [[float(s * (i == j)) for j in range(d)] for i in range(d) for s in (1, -1)]
    for rows, most in ((cross, 4), ([[1.0, 2.0, 3.0]], 0), ([[1.0, 2.0], [1.0, 2.0]], 0), ([[0.0, 5.0], [4.0, 5.0], [1.0, 5.0]], 1), ([[], []], 0)):
        got = gathered(run(frame(spark, rows)))
        assert all(sorted(r) == list(range(1, most + 1)) for r in got.values()) and bool(got) == bool(most)
        assert all(x["identity_error"] < 1e-12 for r in got.values() for x in r.values())
    assert run(frame(spark, [[1.0]]).limit(0)).count() == 0
    assert sorted({len(r) for r in gathered(run(frame(spark, [*cross, [1.0], [2.0]]))).values()}) == [4]     # another length


def test_far_values_stay_exact(spark):
    rows = [[1e9 * k, 1e12 * (k % 3), float(k)] for k in range(-5, 6)] + [[3e38, 0.0, 0.0]]
    got = gathered(run(frame(spark, rows[:-1])))
    n, want, _ = brute(rows[:-1])
    assert all(r[1]["n"] == n and r[1]["deviation"] == (want[k][0] if want[k][0] < 1 << 63 else None) for k, r in got.items())
    assert run(frame(spark, rows)).count() > 0


def test_polynomial_and_roots_of_random_matrices():
    rng = np.random.default_rng(5)
    for d, rank in ((1, 1), (5, 5), (7, 3), (9, 9)):
        b = rng.integers(-9, 9, (d, rank)).astype(object)
        m = b.dot(b.T)
        trace = int(m.trace())
        primes = charpoly.primes_below(1 << 31, charpoly.primes_needed(trace, d))
        poly = charpoly.combined(charpoly.charpoly_mod(m, primes).tolist(), primes)
        for x in range(-2, d):                             # det(x - m) by fractions
            a = [[Fraction(int(x * (i == j)) - int(m[i, j])) for j in range(d)] for i in range(d)]
            det = Fraction(1)
            for k in range(d):
                p = next((i for i in range(k, d) if a[i][k]), None)
                if p is None:
                    det = Fraction(0)
                    break
                if p != k:
                    a[k], a[p], det = a[p], a[k], -det
                det *= a[k][k]
                for i in range(k + 1, d):
                    a[i] = [u - a[i][k] / a[k][k] * w for u, w in zip(a[i], a[k])]
            assert det == sum(c * x**k for k, c in enumerate(poly))
        roots = charpoly.largest_roots(poly, d, trace)
        want = [v for v in np.linalg.eigvalsh(m.astype(float))[::-1] if v > 1e-6]
        assert np.allclose([float(r.high) for r in roots for _ in range(r.multiplicity)], want, rtol=0.3)
        for r in roots:
            r.refine(Fraction(1, 1 << 40))
        assert np.allclose([float(r.high) for r in roots for _ in range(r.multiplicity)], want)


def test_multiple_roots_are_split_off():
    f = [1]
    for root, times in ((3, 2), (5, 1), (8, 3), (0, 2)):
        for _ in range(times):
            f = [a - root * b for a, b in zip([0, *f], [*f, 0])]
    got = charpoly.largest_roots(f, 6, 100)
    for r in got:
        r.refine(Fraction(1, 1 << 30))
    assert [(round(float(r.high)), r.multiplicity) for r in got] == [(8, 3), (5, 1), (3, 2)]


def test_registered_query(spark):
    rows = [r["embedding"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()]
    x = np.floor(np.array(rows, np.float32).astype(float) * 64).astype(np.int64)
    values, vectors = np.linalg.eigh(np.cov(np.unique(x, axis=0).T, bias=True))
    got = queries.QUERIES["op11_embedding_whitening"](spark, SMALL).toPandas().pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = (x - np.unique(x, axis=0).mean(0)) @ vectors[:, ::-1][:, :16] / np.sqrt(values[::-1][:16])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-7)
    out = queries.QUERIES["op11_embedding_whitening"](spark, MIDDLE)
    assert Counter(dict(out.dtypes)[c] for c in ("n", "deviation")) == {"bigint": 2} and out.count() == 16 * 2000
    assert out.agg(F.max("identity_error")).first()[0] < 1e-4
