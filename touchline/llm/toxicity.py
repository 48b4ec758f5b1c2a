"""Toxicity: a linear-chain conditional random field tags toxic tokens.

Training reads a bounded sample of labelled documents (``per_class`` of each class,
texts up to ``max_chars``), in three folds of the ids' hash. Two folds give labelled
tokens: in toxic documents, tokens one of whose features (word, prefixes, suffix) is
found in toxic documents far more often than in clean ones; all other tokens are
clean. A chain of two labels over each line is fitted to them by maximum likelihood
with weight decay; gradients are the forward-backward marginals. The third fold fits
the step from a document's marginals (their sum of squares and their maximum) to its score.

Scoring is a map stage with the model (a table of feature weights) broadcast: for
two labels the forward and backward passes are recursions of one log-odds, run over
all lines of a chunk of texts side by side. A document's tokens with a marginal of a
half or more give the offending spans.

Defined results: a null or blank text has no tokens and gets the score of no
evidence; a null id is not held out and never labelled; ids labelled twice with
different marks are left out of training; without labels of both classes every
score is the labelled share of toxic documents (0 without labels); equal texts get
equal scores; an empty table gives an empty result; the input's columns travel in a struct.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, least_by_hash, map_arrow, row_struct, text_of

PER_CLASS = 1200             # labelled documents of each class that training reads at most
SAMPLE_CHARS = 12_000_000    # characters of whole texts that training reads at most, in the order of the ids' hash
MIN_DOCS = 4                 # toxic documents in which a telling feature is found at least
LOG_ODDS = 3.0               # how much more often a telling feature is found in toxic documents
STEPS, RATE, DECAY = 60, 0.3, 1e-3
PREFIXES = range(4, 9)
CHUNK_CHARS = 1 << 20
CACHE_SIZE = 1 << 17
FOLDS = 5                    # of the ids' crc32; fold 0 is held out, fold 1 calibrates
EDGES = ".,;:!?\"'()[]{}<>*#$%&|~_-"
_WORD = re.compile(r"\S+")


def fold(id_col: str) -> Column:
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(-1))


def features(word: str) -> tuple[str, ...]:
    """The word, its prefixes of four to eight characters where it is longer, and its suffix."""
    return "=" + word, *["^" + word[:n] for n in PREFIXES if n < len(word)], "$" + word[-3:]


def lines_of(text: str) -> list[list[str]]:
    """The bare lower-case tokens of each line that has some."""
    rows = ([w.strip(EDGES) for w in line.split()] for line in text.lower().split("\n"))
    return [r for r in rows if r]


class Chain(NamedTuple):
    """Weights of the features of a toxic token (``bias`` included once), and of the moves between labels."""
    weights: dict[str, float]
    bias: float
    moves: np.ndarray        # [from, to]

    def unary(self, word: str) -> float:
        w = self.weights
        return self.bias + sum([w.get(f, 0.0) for f in features(word)])


class _Layout(NamedTuple):
    """Lines side by side: at step t the first ``running[t]`` lines, longest first, have a token."""
    order: np.ndarray
    starts: np.ndarray
    running: np.ndarray


def _layout(sizes: np.ndarray) -> _Layout:
    starts = np.concatenate([[0], np.cumsum(sizes[:-1])]).astype(np.int64)
    order = np.argsort(-sizes, kind="stable")
    running = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), "left")
    return _Layout(order, starts[order], running)


def _log_odds(u: np.ndarray, moves: np.ndarray, lay: _Layout) -> tuple[np.ndarray, np.ndarray]:
    """By token the log-odds of the toxic label from what comes up to it, and from what follows."""
    ahead, back = np.empty_like(u), np.zeros_like(u)
    r = None
    for t, k in enumerate(lay.running):
        at = lay.starts[:k] + t
        if t:
            r = r[:k]
            r = u[at] + np.logaddexp(moves[0, 1], r + moves[1, 1]) - np.logaddexp(moves[0, 0], r + moves[1, 0])
        else:
            r = u[at]
        ahead[at] = r
    for t in range(len(lay.running) - 1, 0, -1):
        at = lay.starts[:lay.running[t]] + t
        q = u[at] + back[at]
        back[at - 1] = np.logaddexp(moves[1, 0], q + moves[1, 1]) - np.logaddexp(moves[0, 0], q + moves[0, 1])
    return ahead, back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def marginals(u: np.ndarray, moves: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ahead, back = _log_odds(u, moves, _layout(sizes))
    return _sigmoid(ahead + back)


# --- training ----------------------------------------------------------------


def telling_features(docs: list[tuple[list[list[str]], int]], min_docs: int = MIN_DOCS, log_odds: float = LOG_ODDS) -> set[str]:
    found = (Counter(), Counter())
    for rows, toxic in docs:
        found[toxic].update({f for row in rows for w in row if w for f in features(w)[:-1]})
    n = [sum(1 for _, t in docs if t == k) for k in (0, 1)]
    return {f for f, c in found[1].items() if c >= min_docs and
            np.log((c + 0.5) / (n[1] + 1)) - np.log((found[0][f] + 0.5) / (n[0] + 1)) >= log_odds}


def fit_chain(docs: list[tuple[list[list[str]], int]], min_docs: int = MIN_DOCS, log_odds: float = LOG_ODDS) -> Chain:
    """Fit the chain to the token labels that the documents' marks imply."""
    telling = telling_features(docs, min_docs, log_odds)
    words: dict[str, int] = {}
    tokens, marks, sizes = [], [], []
    for rows, toxic in docs:
        for row in rows:
            tokens += [words.setdefault(w, len(words)) for w in row]
            marks += [toxic and any(f in telling for f in features(w)[:-1]) for w in row] if toxic else [0] * len(row)
            sizes.append(len(row))
    names: dict[str, int] = {}
    of_word = [[names.setdefault(f, len(names)) for f in features(w)] for w in words]
    cuts = np.cumsum([0] + [len(f) for f in of_word[:-1]])
    spread = np.repeat(np.arange(len(words)), [len(f) for f in of_word])
    of_word = np.array([k for f in of_word for k in f])
    tokens, y, sizes = np.array(tokens), np.array(marks, float), np.array(sizes)
    lay = _layout(sizes)
    last = np.cumsum(sizes) - 1
    inner = np.ones(len(tokens), bool)
    inner[last] = False
    before = np.flatnonzero(inner)
    y0, y1 = y[before], y[before + 1]
    seen = np.array([[((1 - y0) * (1 - y1)).sum(), ((1 - y0) * y1).sum()], [(y0 * (1 - y1)).sum(), (y0 * y1).sum()]])

    n = len(names)
    x = np.zeros(n + 5)                                  # feature weights, bias, moves
    x[n] = -4.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        moves = x[n + 1:].reshape(2, 2)
        u = (np.add.reduceat(x[of_word], cuts) + x[n])[tokens]
        ahead, back = _log_odds(u, moves, lay)
        off = _sigmoid(ahead + back) - y
        by_word = np.bincount(tokens, off, len(words))
        grad = np.zeros_like(x)
        grad[:n] = np.bincount(of_word, by_word[spread], n)
        grad[n] = off.sum()
        a, q = ahead[before], u[before + 1] + back[before + 1]
        joint = np.stack([np.full_like(a, moves[0, 0]), moves[0, 1] + q, moves[1, 0] + a, moves[1, 1] + a + q])
        joint = np.exp(joint - joint.max(axis=0))
        grad[n + 1:] = (joint / joint.sum(axis=0)).sum(axis=1) - seen.ravel()
        grad = grad / max(1.0, y.sum()) + DECAY * x
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = {f: float(x[k]) for f, k in names.items() if abs(x[k]) > 0.05}
    return Chain(weights, float(x[n]), x[n + 1:].reshape(2, 2).copy())


def fit_logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method; the constant's weight is the last."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = decay * np.eye(len(w))
    for _ in range(30):
        p = _sigmoid(x @ w)
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + decay * w)
    return w


class Model(NamedTuple):
    chain: Chain | None
    scale: np.ndarray        # weights of the evidence and the constant

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return _sigmoid(evidence @ self.scale[:-1] + self.scale[-1])


class _Unary(dict):
    """Scores of tokens, kept for the first ``room`` different ones."""

    def __init__(self, chain: Chain, room: int = CACHE_SIZE):
        self.chain, self.room = chain, room

    def __missing__(self, word: str) -> float:
        u = self.chain.unary(word)
        if self.room > 0:
            self.room -= 1
            self[word] = u
        return u


def _evidence(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """By document: the log of the marginals' sum of squares (long clean texts add next to nothing to it), and the highest marginal."""
    out = np.zeros((len(counts), 2))
    some = np.flatnonzero(counts)
    if len(some):
        cuts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
        out[some, 0] = np.log1p(np.add.reduceat(p * p, cuts))
        out[some, 1] = np.maximum.reduceat(p, cuts)
    return out


def judge(texts: list[str], unary: _Unary) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each text's evidence, and its tokens' marginals in order."""
    sizes, counts, flat = [], [], []
    for t in texts:
        rows = lines_of(t)
        sizes += [len(r) for r in rows]
        counts.append(sum(map(len, rows)))
        flat += [unary[w] for r in rows for w in r]
    counts = np.array(counts, np.int64)
    u = np.array(flat, float)
    p = marginals(u, unary.chain.moves, np.array(sizes, np.int64)) if len(u) else u
    return _evidence(p, counts), np.split(p, np.cumsum(counts)[:-1]) if len(counts) else []


def spans_of(text: str, p: np.ndarray) -> list[dict]:
    """Offending runs of tokens in code points, end exclusive, with their highest marginal."""
    out: list[dict] = []
    if not (p >= 0.5).any():
        return out
    k = 0
    for line in re.finditer("[^\n]+", text):
        joins = False
        for m in _WORD.finditer(text, *line.span()):
            if p[k] >= 0.5:
                if joins:
                    out[-1]["end"], out[-1]["p"] = m.end(), max(out[-1]["p"], float(p[k]))
                else:
                    out.append({"start": m.start(), "end": m.end(), "p": float(p[k])})
            joins = bool(p[k] >= 0.5)
            k += 1
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        per_class: int = PER_CLASS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class outside fold 0, the first by their ids' hash,
    and of those on the first whose texts fit into ``sample_chars`` together; on whole texts, of any length."""
    marked = labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("y"), fold(id_col).alias("fold")).filter(
        "id IS NOT NULL AND y IN (0, 1) AND fold > 0")
    chosen = least_by_hash(marked.filter("y = 1"), "id", per_class).unionByName(
        least_by_hash(marked.filter("y = 0"), "id", per_class))
    marks: dict = {}
    for r in chosen.collect():
        marks.setdefault(r["id"], set()).add((r["y"], r["fold"]))
    marks = {k: next(iter(v)) for k, v in marks.items() if len(v) == 1}
    share = sum(y for y, _ in marks.values()) / max(1, len(marks))
    constant = Model(None, np.array([0.0, 0.0, np.log(max(share, 1e-9) / max(1 - share, 1e-9))]))
    if len({y for y, _ in marks.values()}) < 2:
        return constant
    ids = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in sorted(marks)], T.StructType([
        T.StructField("id", labels.schema[id_col].dataType)])))
    found = docs.select(col(id_col).alias("id"), text_of(text_col).alias("text")).join(ids, "id")
    sizes = sorted({(zlib.crc32(str(r["id"]).encode()), r["id"]): r["n"] for r in found.groupBy("id").agg(F.max(F.length("text")).alias("n")).collect()}.items())
    total, fit_in = 0, []
    for (_, k), n in sizes:
        if total + n <= sample_chars:
            total, fit_in = total + n, [*fit_in, k]
    few = docs.sparkSession.createDataFrame([(k,) for k in fit_in], T.StructType([T.StructField("id", labels.schema[id_col].dataType)]))
    texts = found.join(F.broadcast(few), "id").groupBy("id").agg(F.min("text").alias("text")).orderBy("id").limit(2 * per_class).collect()
    read = [(lines_of(r["text"]), *marks[r["id"]], r["text"]) for r in texts]
    train = [(rows, y) for rows, y, k, _ in read if k > 1]
    held = [(t, y) for _, y, k, t in read if k == 1]
    if len({y for _, y in train}) < 2 or len({y for _, y in held}) < 2:
        return constant
    chain = fit_chain(train)
    evidence, _ = judge([t for t, _ in held], _Unary(chain))
    return Model(chain, fit_logistic(evidence, np.array([y for _, y in held], float)))


# --- scoring -----------------------------------------------------------------

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())])


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    chunk, held = [], 0
    for t in texts:
        chunk.append(t)
        held += len(t)
        if held >= CHUNK_CHARS:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


def tag(docs: DataFrame, model: Model, text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: ``row`` (or the ``carry`` columns), ``score`` and ``spans``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [row_struct(docs).alias("row")] if carry is None else [c.alias(k) for k, c in carry.items()]
    packed = docs.select(*kept, text_of(text_col).alias("_text"))
    fields = packed.schema.fields[:-1]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        unary = _Unary(m.chain) if m.chain else None
        for batch in batches:
            scores, spans = [], []
            for texts in _chunks(batch.column(len(fields)).to_pylist()):
                if unary is None:
                    scores.append(m.score(np.zeros((len(texts), 2))))
                    spans += [[]] * len(texts)
                    continue
                evidence, by_token = judge(texts, unary)
                scores.append(m.score(evidence))
                spans += [spans_of(t, p) for t, p in zip(texts, by_token)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(spans, span)],
                names=[*(f.name for f in fields), "score", "spans"])
    return map_arrow(packed, run, T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN))]))
