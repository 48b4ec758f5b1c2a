"""Whitening of embeddings through the exact characteristic polynomial of their scatter.

Components become integers ``floor(scale * c)``, so the scatter of the fit list (each
distinct vector once) is an exact integer matrix: ``n * sum(x x') - S S'``, ``n^2``
times the covariance. An offset added to every component doesn't change it, so sums
are kept without one.

1. One scan drops unusable rows; the distinct vectors are stored.
2. Each task reduces its vectors to exact second moments; tasks' sums are added by Spark
   in two halves of 60 bits, which no table overflows.
3. The scatter's polynomial is computed modulo as many primes as its coefficients need,
   a group of primes a task; the few numbers of each are combined by Chinese remaindering.
4. The largest roots are isolated by exact counts; each root is refined, and its null
   space found by inverse iteration, in a task of its own.
5. A scan of the stored vectors measures the covariance of the whitened ones; a last one
   of the table projects all rows.

What passes through the driver depends on the dimension ``d`` alone: ``d^2`` sums,
``d + 1`` residues a prime, ``d`` numbers a component.

Defined results: rows whose vector is null, or holds a null, a NaN or an infinity, are
left out; so are vectors of another length than most (of lengths equally frequent, the
longest). Components whose eigenvalue is zero have no whitened values and are left out,
so that vectors in a plane give two components and a single vector none. A repeated
eigenvalue gets any orthonormal basis of its space, the same for all rows. ``deviation``
is null where it exceeds 64 bits. Repeated rows each get their own results; an empty
table gives an empty result; columns reach the result by ``carry`` only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import charpoly
from .common import col, map_arrow, stored

COMPONENTS = 16
SCALE = 64
PRIMES_A_TASK = 32
HALF = 60                # bits of the lower half of a sum
EXACT = 1 << 53


def usable(vector: Column) -> Column:
    """A vector without nulls, NaNs and infinities."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return vector.isNotNull() & F.forall(vector, fine)


def integers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * float(scale)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of an integer matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _moments(d: int):
    """``i, j, hi, lo`` for each task: sums of products (``i <= j``), sums (``j = -1``) and the count (both -1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, one, n = np.zeros((d, d), dtype=object), np.zeros(d, dtype=object), 0
        for batch in (b for b in batches if b.num_rows):
            x = _matrix(batch.column(0))
            n += len(x)
            most = max(1, int(np.abs(x.astype(object)).max()) if x.size and x.min() == np.iinfo(np.int64).min else int(np.abs(x).max(initial=0)))
            step = max(1, min(len(x), (EXACT - 1) // most**2)) if most**2 < EXACT else 0
            if step:
                for k in range(0, len(x), step):          # sums of products that doubles hold exactly
                    y = x[k:k + step].astype(np.float64)
                    total += (y.T @ y).astype(np.int64).astype(object)
                    one += y.sum(0).astype(np.int64).astype(object)
            else:
                y = x.astype(object)
                total, one = total + y.T.dot(y), one + y.sum(0)
        if n:
            cells = [(i, j, int(total[i, j])) for i in range(d) for j in range(i, d)]
            cells += [(i, -1, int(one[i])) for i in range(d)] + [(-1, -1, n)]
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()),
                 pa.array([Decimal(c[2] >> HALF) for c in cells], kind),
                 pa.array([Decimal(c[2] & ((1 << HALF) - 1)) for c in cells], kind)], names=["i", "j", "hi", "lo"])
    return run


def scatter(fit: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """``n``, the sums and the integer scatter ``n * sum(x x') - S S'`` of the stored vectors ``x``."""
    parts = map_arrow(fit, _moments(d), "i int, j int, hi decimal(38,0), lo decimal(38,0)")
    cells = {(r["i"], r["j"]): (int(r["hi"]) << HALF) + int(r["lo"])
             for r in parts.groupBy("i", "j").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect()}
    n = cells.get((-1, -1), 0)
    sums = np.array([cells.get((i, -1), 0) for i in range(d)], dtype=object)
    second = np.array([[cells.get((min(i, j), max(i, j)), 0) for j in range(d)] for i in range(d)], dtype=object).reshape(d, d)
    return n, sums, n * second - np.outer(sums, sums)


def _residues(matrix: np.ndarray, primes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = [primes[k] for g in batch.column(0).to_pylist() for k in range(g * PRIMES_A_TASK, min(len(primes), (g + 1) * PRIMES_A_TASK))]
            rows = charpoly.charpoly_mod(matrix, mine)
            yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int64()), pa.array(rows.tolist(), pa.list_(pa.int64()))], names=["p", "c"])
    return run


def _components(matrix: np.ndarray, roots: list[charpoly.Root], gaps: list[Fraction]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                vectors, value = charpoly.null_vectors(matrix, roots[k], gaps[k])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(vectors), pa.int32()), pa.array(range(len(vectors)), pa.int32()),
                     pa.array(vectors, pa.list_(pa.float64())), pa.array([f"{value.numerator}/{value.denominator}"] * len(vectors))],
                    names=["root", "place", "vector", "value"])
    return run


def principal(spark, matrix: np.ndarray, components: int = COMPONENTS) -> list[tuple[Fraction, np.ndarray]]:
    """Up to ``components`` eigenvalues above zero of a symmetric integer matrix without
    negative ones, falling, each with a unit eigenvector."""
    d, trace = len(matrix), int(matrix.trace()) if len(matrix) else 0
    if not trace:
        return []
    content = math.gcd(*(int(x) for x in matrix.flat))
    matrix, trace = matrix // content, trace // content
    primes = charpoly.primes_below(1 << 31, charpoly.primes_needed(trace, d))
    groups = -(-len(primes) // PRIMES_A_TASK)
    parts = map_arrow(spark.range(0, groups, 1, groups), _residues(matrix, primes), "p long, c array<long>").collect()
    poly = charpoly.combined([r["c"] for r in parts], [r["p"] for r in parts])
    roots = charpoly.largest_roots(poly, components, trace)
    gaps = charpoly.gaps(roots)
    if sum(r.multiplicity for r in roots[:-1]) >= components:
        roots = roots[:-1]                                # the last one only gives the gap
    parts = map_arrow(spark.range(0, len(roots), 1, len(roots)), _components(matrix, roots, gaps),
                      "root int, place int, vector array<double>, value string").collect()
    parts = sorted(parts, key=lambda r: (r["root"], r["place"]))[:components]
    return [(Fraction(r["value"]) * content, np.array(r["vector"])) for r in parts]


class _Projection:
    """Exact centring of integer vectors, and their whitened values."""

    def __init__(self, n: int, sums: np.ndarray, found: list[tuple[Fraction, np.ndarray]]):
        self.n, self.sums = n, sums
        with localcontext() as ctx:
            ctx.prec = 40                                 # over n * sqrt(eigenvalue of the covariance), the root of the scatter's
            roots = [float((Decimal(e.numerator) / Decimal(e.denominator)).sqrt()) for e, _ in found]
        self.axes = np.stack([v for _, v in found], axis=1) / np.array(roots)

    def centred(self, x: np.ndarray) -> np.ndarray:
        most = int(np.abs(x).max(initial=0)) if not x.size or x.min() > np.iinfo(np.int64).min else 1 << 63
        if self.n * most + int(np.abs(self.sums).max(initial=0)) < 1 << 62:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def whitened(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = self.centred(x)
        return z, z.astype(np.float64) @ self.axes


def _spread(projection: _Projection):
    """``i, j, v`` for each task: sums of products of whitened values, and their sums (``j = -1``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = projection.axes.shape[1]
        total, one = np.zeros((k, k)), np.zeros(k)
        for batch in (b for b in batches if b.num_rows):
            _, w = projection.whitened(_matrix(batch.column(0)))
            total, one = total + w.T @ w, one + w.sum(0)
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, np.arange(k)), pa.int32()), pa.array(np.append(j, np.full(k, -1)), pa.int32()),
             pa.array(np.append(total[i, j], one))], names=["i", "j", "v"])
    return run


def identity_error(fit: DataFrame, projection: _Projection) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    k, n = projection.axes.shape[1], projection.n
    cells = map_arrow(fit, _spread(projection), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    v = {(r["i"], r["j"]): r["v"] / n for r in cells}
    return max(abs(v[i, j] - v[i, -1] * v[j, -1] - (i == j)) for i in range(k) for j in range(i, k))


def _project(projection: _Projection, explained: list[float], error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = projection.axes.shape[1]
        for batch in (b for b in batches if b.num_rows):
            z, w = projection.whitened(_matrix(batch.column(1)))
            far = np.abs(z).max(initial=0) if z.dtype == object else int(np.abs(z).max(initial=0))
            if z.dtype != object and z.shape[1] * far**2 < 1 << 63:
                deviation = pa.array((z * z).sum(1), pa.int64())
            else:
                sums = [sum(int(c) ** 2 for c in row) for row in z]
                deviation = pa.array([s if s < 1 << 63 else None for s in sums], pa.int64())
            rows = pa.array(np.repeat(np.arange(len(w)), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w))),
                 pa.array(np.full(len(w) * k, projection.n), pa.int64()), deviation.take(rows), pa.array(w.reshape(-1)),
                 pa.array(np.tile(explained, len(w))), pa.array(np.full(len(w) * k, error))],
                names=["carry", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(vectors: DataFrame, vector_col: str = "embedding", carry: dict[str, Column] | None = None,
           components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row per usable input row and component: the ``carry`` columns (expressions over
    ``vectors``), ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    spark, carry = vectors.sparkSession, carry or {}
    rows = vectors.select(F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in carry.items()]).alias("carry"), col(vector_col).alias("v"))
    rows = rows.filter(usable(F.col("v"))).select("carry", integers(F.col("v"), scale).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    rows = rows.filter(F.size("x") == d)
    found: list = []
    if d:
        fit = stored(rows.select("x").distinct(), "fit")
        n, sums, matrix = scatter(fit, d)
        found = principal(spark, matrix, components)
    schema = T.StructType([rows.schema["carry"], T.StructField("component", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("n", "deviation")],
                           *[T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]])
    if found:
        projection = _Projection(n, sums, found)
        trace = int(matrix.trace())
        out = map_arrow(rows, _project(projection, [float(e / trace) for e, _ in found], identity_error(fit, projection)), schema)
    else:
        out = spark.createDataFrame([], schema)
    return out.select(*[F.col("carry").getField(k).alias(k) for k in carry], *schema.fieldNames()[1:])
