"""R-tree boxes over integer vectors, and best-first search by inner product.

A tree has two levels: tiles, and the leaves of a tile. A box's coordinates bound the
inner product with a query from both sides, coordinate by coordinate. Searches take boxes
from a queue in falling order of their upper bounds, several at a time, so that the rows
of the leaves among them are scored in one product. All numbers are exact: doubles while
they hold every sum, Python integers beyond.
"""

from __future__ import annotations

import heapq

import numpy as np

LEAF = 32                # rows of a leaf
TAKE = 16                # boxes taken from the queue at a time
EXACT = 1 << 53


def str_order(x: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Sort-tile-recursive order of a tile's rows: slabs along the widest coordinate, each sorted along the next."""
    if len(x) <= leaf or x.shape[1] == 0:
        return np.arange(len(x))
    by = np.argsort(-(x.max(0).astype(float) - x.min(0)), kind="stable")[:2]
    order = np.argsort(x[:, by[0]], kind="stable")
    if len(by) < 2:
        return order
    slab = leaf * int(np.ceil(np.sqrt(len(x) / leaf)))
    return np.concatenate([order[k:k + slab][np.argsort(x[order[k:k + slab], by[1]], kind="stable")] for k in range(0, len(x), slab)])


def boxes(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum.reduceat(x, starts, axis=0), np.maximum.reduceat(x, starts, axis=0)


def exactly(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as doubles where products and their sums are exact, else as Python integers."""
    d = max((a.shape[-1] for a in arrays), default=0)
    most = max((max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0)))) for a in arrays), default=0)
    return [a.astype(np.float64 if d * most * most < EXACT else object) for a in arrays]


class Tree:
    """The rows of some tiles. ``ids`` break ties, ``uids`` tell rows apart."""

    def __init__(self, tiles: list[tuple[np.ndarray, np.ndarray, np.ndarray]], leaf: int = LEAF):
        """``tiles``: vectors in their leaves' order, ids, uids."""
        sizes = [len(x) for x, _, _ in tiles]
        self.x = np.concatenate([x for x, _, _ in tiles])
        self.ids, self.uids = (np.concatenate([t[k] for t in tiles]) for k in (1, 2))
        starts, self.leaves, at = [], [], 0
        for n in sizes:
            first = len(starts)
            starts += range(at, at + n, leaf)
            self.leaves.append((first, len(starts)))
            at += n
        self.starts, self.ends = np.array(starts), np.array([*starts[1:], at])
        self.leaf_boxes = boxes(self.x, self.starts)
        self.tile_boxes = boxes(self.x, np.cumsum([0, *sizes[:-1]]))

    def bounds(self, queries: np.ndarray):
        """For each query and box the least and the greatest inner product that the box allows: tiles, then leaves."""
        q, *sides = exactly(queries, *self.tile_boxes, *self.leaf_boxes)
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        for lo, hi in (sides[:2], sides[2:]):
            yield plus.dot(lo.T) + minus.dot(hi.T), plus.dot(hi.T) + minus.dot(lo.T)

    def search(self, queries: np.ndarray, states: list) -> None:
        """Offer each query's state the rows that it may still want, best boxes first."""
        (tile_lo, tile_hi), (leaf_lo, leaf_hi) = self.bounds(queries)
        q, x = exactly(queries, self.x)
        for k, state in enumerate(states):
            queue = [(-hi, t, True) for t, hi in enumerate(tile_hi[k]) if state.wants(tile_lo[k, t], hi)]
            heapq.heapify(queue)
            while queue:
                rows = []
                for _ in range(min(TAKE, len(queue))):
                    bound, at, is_tile = heapq.heappop(queue)
                    if not state.wants((tile_lo if is_tile else leaf_lo)[k, at], -bound):
                        continue
                    if is_tile:
                        for leaf in range(*self.leaves[at]):
                            if state.wants(leaf_lo[k, leaf], leaf_hi[k, leaf]):
                                heapq.heappush(queue, (-leaf_hi[k, leaf], leaf, False))
                    else:
                        rows.append(np.arange(self.starts[at], self.ends[at]))
                if rows:
                    rows = np.concatenate(rows)
                    state.offer(x[rows].dot(q[k]), self.ids[rows], self.uids[rows])


class Best:
    """The ``k`` best rows with scores in ``[low, high]``: higher first, ties by smaller id."""

    def __init__(self, k: int, low=None, high=None, own: int | None = None):
        self.k, self.low, self.high, self.own, self.rows = k, low, high, own, []

    def wants(self, least, most) -> bool:
        """Whether a box with these bounds may hold a row to keep: it meets the window and isn't strictly below the k-th."""
        return (self.high is None or least <= self.high) and (self.low is None or most >= self.low) and (
            len(self.rows) < self.k or most >= self.rows[-1][0])

    def offer(self, scores: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        fits = uids != self.own if self.own is not None else np.ones(len(scores), bool)
        if self.low is not None:
            fits &= scores >= self.low
        if self.high is not None:
            fits &= scores <= self.high
        if len(self.rows) == self.k:
            fits &= scores >= self.rows[-1][0]
        at = np.flatnonzero(fits)
        if len(at) > 4 * self.k:                          # all of the best scores, with their ties
            kth = np.partition(scores[at], len(at) - self.k)[len(at) - self.k]
            at = at[scores[at] >= kth]
        if len(at):
            more = zip((int(s) for s in scores[at]), ids[at].tolist(), uids[at].tolist())
            self.rows = sorted([*self.rows, *more], key=lambda r: (-r[0], r[1], r[2]))[:self.k]


class Windows:
    """Several :class:`Best` of one query, searched together."""

    def __init__(self, parts: list[Best]):
        self.parts = parts

    def wants(self, least, most) -> bool:
        return any(p.wants(least, most) for p in self.parts)

    def offer(self, scores: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        for p in self.parts:
            p.offer(scores, ids, uids)
