"""Exact characteristic polynomials of integer matrices, their real roots, and null vectors.

The polynomial is computed modulo 31-bit primes (reduction to Hessenberg form, all
primes of a task in one array) and combined by Chinese remaindering. For a symmetric
matrix all roots are real, so the sign changes of the polynomial shifted to a point
count the roots above it exactly; intervals are halved until each holds one root.
Null vectors come from inverse iteration in decimal arithmetic whose precision follows
from the gap to the neighbouring roots.
"""

from __future__ import annotations

import math
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np


def primes_below(limit: int, count: int) -> list[int]:
    """The ``count`` largest odd primes under ``limit`` (at most 2^32)."""
    def is_prime(n: int) -> bool:
        if any(n % p == 0 for p in (3, 5, 7, 11, 13)):
            return n in (3, 5, 7, 11, 13)
        s = ((n - 1) & -(n - 1)).bit_length() - 1
        for base in (2, 3, 5, 7):                       # enough below 3,215,031,751
            x = pow(base, (n - 1) >> s, n)
            if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
                return False
        return True
    out, n = [], limit - 1 - limit % 2
    while len(out) < count:
        if is_prime(n):
            out.append(n)
        n -= 2
    return out


def primes_needed(trace: int, d: int) -> int:
    """31-bit primes that hold every coefficient: with roots >= 0 of sum ``trace``, the k-th
    elementary symmetric function is at most ``C(d, k) (trace / d)^k``."""
    if d == 0:
        return 1
    bound = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    return (bound.bit_length() + 2) // 30 + 1


def charpoly_mod(matrix: np.ndarray, primes: list[int]) -> np.ndarray:
    """Coefficients (constant first) of ``det(x - matrix)`` modulo each prime, one row a prime."""
    d, p = len(matrix), np.array(primes, np.int64)
    a = np.stack([(matrix % int(q)).astype(np.int64) for q in primes])
    at, mod = np.arange(len(primes)), p[:, None, None]
    for k in range(d - 2):
        pivot = k + 1 + np.argmax(a[:, k + 1:, k] != 0, axis=1)
        rows = a[at, pivot]
        a[at, pivot], a[:, k + 1] = a[:, k + 1], rows
        cols = a[at, :, pivot]
        a[at, :, pivot], a[:, :, k + 1] = a[:, :, k + 1].copy(), cols
        inverse = np.array([pow(int(x), -1, int(q)) if x else 0 for x, q in zip(a[:, k + 1, k], p)], np.int64)
        u = a[:, k + 2:, k] * inverse[:, None] % p[:, None]
        a[:, k + 2:] = (a[:, k + 2:] - u[:, :, None] * a[:, k + 1, None, :] % mod) % mod
        a[:, :, k + 1] = (a[:, :, k + 1] + (a[:, :, k + 2:] * u[:, None, :] % mod).sum(2)) % p[:, None]
    poly = np.zeros((d + 1, len(primes), d + 1), np.int64)
    poly[0, :, 0] = 1
    for k in range(d):
        poly[k + 1, :, 1:] = poly[k, :, :-1]
        poly[k + 1] -= a[:, k, k, None] * poly[k] % p[:, None]
        below = np.ones(len(primes), np.int64)
        for i in range(k - 1, -1, -1):
            below = below * a[:, i + 1, i] % p
            poly[k + 1] -= (a[:, i, k] * below % p)[:, None] * poly[i] % p[:, None]
        poly[k + 1] %= p[:, None]
    return poly[d]


def combined(residues: list[list[int]], primes: list[int]) -> list[int]:
    """The integers of least absolute value with the given residues (one row a prime)."""
    x, m = [0] * len(residues[0]), 1
    for row, p in zip(residues, primes):
        inverse = pow(m, -1, p)
        x = [a + m * ((r - a) * inverse % p) for a, r in zip(x, row)]
        m *= p
    return [a - m if 2 * a > m else a for a in x]


def _primitive(f: list[int]) -> list[int]:
    while f and f[-1] == 0:
        f = f[:-1]
    g = math.gcd(*f) if f else 1
    return [c // g for c in f] if not f or f[-1] > 0 else [-c // g for c in f]


def _derivative(f: list[int]) -> list[int]:
    return [k * c for k, c in enumerate(f)][1:]


def _gcd(f: list[int], g: list[int]) -> list[int]:
    f, g = _primitive(f), _primitive(g)
    while g:
        r = f
        while len(r) >= len(g):
            lead, shift = r[-1], len(r) - len(g)
            r = [g[-1] * c for c in r]
            for i, c in enumerate(g):
                r[i + shift] -= lead * c
            r = r[:-1]
            while r and r[-1] == 0:
                r = r[:-1]
        f, g = g, _primitive(r)
    return f


def _quotient(f: list[int], g: list[int]) -> list[int]:
    """``f / g`` of primitive polynomials, where it is exact."""
    out, r = [], list(f)
    while len(r) >= len(g):
        c = r[-1] // g[-1]
        out.append(c)
        for i, x in enumerate(g):
            r[len(r) - len(g) + i] -= c * x
        r = r[:-1]
    return out[::-1]


def _surely_square_free(f: list[int], p: int = 2147483629) -> bool:
    """Whether ``f`` and its derivative have no common root modulo a prime, hence none at all."""
    a, b = [c % p for c in f], [c % p for c in _derivative(f)]
    if not a[-1] or not b[-1]:
        return False
    while b:
        inverse = pow(b[-1], -1, p)
        while len(a) >= len(b):
            c, shift = a[-1] * inverse % p, len(a) - len(b)
            for i, x in enumerate(b):
                a[i + shift] = (a[i + shift] - c * x) % p
            a = a[:-1]
            while a and a[-1] == 0:
                a = a[:-1]
        a, b = b, a
    return len(a) == 1


def square_free(f: list[int]) -> list[tuple[list[int], int]]:
    """``f``'s factors without multiple roots, with their multiplicities."""
    f = _primitive(f)
    if len(f) < 2:
        return []
    if _surely_square_free(f):
        return [(f, 1)]
    out, k = [], 1
    g = _gcd(f, _derivative(f))
    rest = _quotient(f, g)
    while len(rest) > 1:
        common = _gcd(rest, g)
        factor = _quotient(rest, common)
        if len(factor) > 1:
            out.append((factor, k))
        rest, g, k = common, _quotient(g, common), k + 1
    return out


def roots_above(f: list[int], num: int, bits: int) -> int:
    """Roots of ``f`` (all real) greater than ``num / 2^bits``: the sign changes of ``f`` shifted there."""
    c = [x << bits * (len(f) - 1 - k) for k, x in enumerate(f)]
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += num * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


class Root:
    """The root of ``f`` in ``(lo, hi] / 2^bits``, the only one there, with its multiplicity."""

    def __init__(self, f: list[int], multiplicity: int, lo: int, hi: int, bits: int):
        self.f, self.multiplicity, self.lo, self.hi, self.bits = f, multiplicity, lo, hi, bits
        self.above = self._value(hi) >= 0 if self._value(hi) else None        # the sign at hi; none: hi is the root

    def _value(self, num: int) -> int:
        out = 0
        for k in range(len(self.f) - 1, -1, -1):
            out = out * num + (self.f[k] << self.bits * (len(self.f) - 1 - k))
        return out

    def halve(self) -> None:
        if self.above is None:                                                  # hi is the root; draw lo nearer
            self.lo, self.hi, self.bits = self.hi * 2 - (self.hi - self.lo), self.hi * 2, self.bits + 1
            return
        self.lo, self.hi, self.bits = self.lo * 2, self.hi * 2, self.bits + 1
        mid = (self.lo + self.hi) // 2
        value = self._value(mid)
        if value == 0:
            self.hi, self.above = mid, None
        elif (value > 0) == self.above:
            self.hi = mid
        else:
            self.lo = mid

    @property
    def low(self) -> Fraction:
        return Fraction(self.lo, 1 << self.bits)

    @property
    def high(self) -> Fraction:
        return Fraction(self.hi, 1 << self.bits)

    def refine(self, width: Fraction) -> None:
        while self.high - self.low > width:
            self.halve()


def largest_roots(f: list[int], count: int, limit: int) -> list[Root]:
    """The roots of ``f`` (all real, none above ``limit``) greater than zero, falling, until their
    multiplicities reach ``count``, and the next one, in intervals an eighth of their gaps wide or less."""
    found: list[Root] = []
    for factor, multiplicity in square_free(f):
        open_ = [(0, limit, 0, roots_above(factor, 0, 0), 0)]
        while open_:
            lo, hi, bits, above_lo, above_hi = open_.pop()
            if above_hi > count or above_lo == above_hi:
                continue
            if above_lo - above_hi == 1:
                found.append(Root(factor, multiplicity, lo, hi, bits))
                continue
            if hi - lo == 1:
                lo, hi, bits = 2 * lo, 2 * hi, bits + 1
            mid = (lo + hi) // 2
            above = roots_above(factor, mid, bits)
            open_ += [(lo, mid, bits, above_lo, above), (mid, hi, bits, above, above_hi)]
    while True:
        found.sort(key=lambda r: r.high, reverse=True)
        close = [r for x, y in zip(found, found[1:]) for r in (x, y)
                 if r.high - r.low > max(Fraction(0), x.low - y.high) / 8]
        close += [r for r in found if r.high - r.low > r.low / 8]
        if not close:
            break
        for r in {id(r): r for r in close}.values():
            r.halve()
    out, n = [], 0
    for r in found:
        out.append(r)
        if n >= count:
            break
        n += r.multiplicity
    return out


def gaps(roots: list[Root]) -> list[Fraction]:
    """For each root a lower bound of the distance to the others and to zero."""
    out = []
    for k, r in enumerate(roots):
        near = [r.low] + ([roots[k - 1].low - r.high] if k else []) + ([r.low - roots[k + 1].high] if k + 1 < len(roots) else [])
        out.append(min(near))
    return out


def _decimal(x: Fraction) -> Decimal:
    return Decimal(x.numerator) / Decimal(x.denominator)


def null_vectors(matrix: np.ndarray, root: Root, gap: Fraction) -> tuple[list[list[float]], Fraction]:
    """Orthonormal vectors, as many as the root's multiplicity, that ``matrix`` (symmetric, of
    Python integers) takes to their multiple by the root; and the root to 120 bits below ``gap``.
    Signs: the entry of largest size is positive."""
    d, norm = len(matrix), max(1, int(np.abs(matrix).sum(axis=1).max()))
    root.refine(min(gap, root.low) / (1 << 120))
    value = (root.low + root.high) / 2
    with localcontext() as ctx:
        ctx.prec = 60 + max(0, len(str(int(norm / gap)))) + len(str(d))
        a = np.array([[Decimal(int(x)) for x in row] for row in matrix], dtype=object).reshape(d, d)
        a[np.arange(d), np.arange(d)] -= _decimal(value)
        tiny, order = Decimal(norm).scaleb(-ctx.prec), np.arange(d)
        for k in range(d):                                # triangular factors, rows in the order of their pivots
            pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            if k + 1 < d:
                a[k + 1:, k] /= a[k, k]
                a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k], a[k, k + 1:])
        out: list[np.ndarray] = []
        for m in range(root.multiplicity):
            v = np.array([Decimal(((i + 1) * 7919 + (m + 1) * 104729 * (i * i + 3)) % 1009 + 1) for i in range(d)], dtype=object)
            for _ in range(2):
                v = v[order]
                for k in range(1, d):
                    v[k] -= a[k, :k].dot(v[:k])
                for k in range(d - 1, -1, -1):
                    v[k] = (v[k] - (a[k, k + 1:].dot(v[k + 1:]) if k + 1 < d else 0)) / a[k, k]
                v = v / max(abs(x) for x in v)
                for _ in range(2):
                    for w in out:
                        v = v - w * v.dot(w)
                v = v / v.dot(v).sqrt()
            out.append(v)
        vectors = [v if max(v, key=abs) > 0 else -v for v in out]
        return [[float(x) for x in v] for v in vectors], value
