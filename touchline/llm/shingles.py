"""Word-shingle sets and MinHash signatures of texts, vectorised over Arrow batches.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a shingle is ``width``
consecutive words. A text with fewer words has its whole sequence as one
shingle, a text without words none. Shingles are compared by 64-bit hashes of
their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[np.arange(65, 91)] = _BYTE[np.arange(97, 123)]          # A-Z as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of ``data``; ``breaks``: positions where a new text starts."""
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    at = breaks[breaks < len(data)]
    first[at] = ~space[at]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    sizes = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), _BASE, dtype=np.uint64))
    return _mix(np.add.reduceat(_BYTE[data[starts[0]:]] * powers[place], starts - starts[0])), starts


def _long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, piece by piece, cut at white space."""
    out, at = [], 0
    while at < len(data):
        end = at + CHUNK_BYTES
        while end < len(data) and not _SPACE[data[end]]:
            more = np.flatnonzero(_SPACE[data[end:end + CHUNK_BYTES]])
            end = end + int(more[0]) if len(more) else end + CHUNK_BYTES
        out.append(_words(data[at:end], np.zeros(1, np.int64))[0])
        at = end
    return np.concatenate(out)


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of one text's word hashes."""
    n = len(words)
    if n == 0:
        return words
    k = min(width, n)
    h = np.full(n - k + 1, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        h = h * _BASE + words[i:n - k + 1 + i]
        h ^= h >> np.uint64(29)
    return np.unique(_mix(h))


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (null: empty)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, "right")) - 1)
        piece, cuts = data[off[i]:off[j]], off[i:j + 1] - off[i]
        if j == i + 1 and len(piece) > CHUNK_BYTES:
            yield _shingles(_long_words(piece), width)
        else:
            hashes, starts = _words(piece, cuts[:-1])
            at = np.searchsorted(starts, cuts)
            for k in range(j - i):
                yield _shingles(hashes[at[k]:at[k + 1]], width)
        i = j


class MinHash:
    """Minima of ``size`` universal hashes (multiply-shift, drawn from ``seed``)."""

    def __init__(self, size: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**64, size, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 2**64, size, dtype=np.uint64)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of unsigned 32-bit minima for each non-empty set."""
        x = np.concatenate(sets) >> np.uint64(32)
        cuts = np.cumsum([0] + [len(s) for s in sets[:-1]])
        out, h = np.empty((len(sets), len(self.a)), np.uint32), np.empty_like(x)
        for k, (a, b) in enumerate(zip(self.a, self.b)):
            np.multiply(x, a, out=h)
            h += b
            out[:, k] = np.minimum.reduceat(h, cuts) >> np.uint64(32)
        return out
