"""Quality classifier by co-training two views of a document.

The content view sees shares measured in the text (stop words, symbols, capitals,
digits, distinct words, repeated lines, word length); the metadata view sees only
the columns beside it (language, source, recorded length by its magnitude). Each is a logistic
regression. Over a few rounds each is calibrated on labelled documents kept apart and
scores a pool of unlabelled ones, and those it is surest of, of both classes and at most in
the labels' proportion, join the other's training rows under the label it gave. Both
scores are then calibrated again and combined by a regression of their log-odds.

The measures are one projection of built-in functions, written once as a narrow
table; training reads bounded samples of it (``max_labelled``, ``max_pool`` rows, the
first by their ids' hash); the final scores are column expressions over the table.

Defined results: a null text counts as empty, null metadata is a value of its own;
a null id is scored, never labelled; ids labelled twice with different marks are left
out; without labels of both classes every score is the labelled share of good
documents (1 without labels, so nothing is dropped); equal rows get equal scores; an
empty table gives an empty result; the input's columns travel in a struct.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, least_by_hash, row_struct, stored, text_of, words_of
from .quality_rules import EDGE_PUNCTUATION, STOP_WORDS, SYMBOLS
from .toxicity import fit_logistic, fold

MAX_LABELLED, MAX_POOL = 6000, 10_000
ROUNDS, PER_ROUND = 5, 200
SURE = 0.8                   # of guessing by the labels' share, the chance of error up to which a view labels a row
LANG_CELLS, SOURCE_CELLS, CHARS_CELLS = 8, 16, 18

CONTENT = ("stop_share", "symbol_share", "capital_share", "digit_share", "distinct_share", "repeated_lines", "word_length")
META = ("log_chars", "no_chars", *(f"chars_{k}" for k in range(CHARS_CELLS)), *(f"lang_{k}" for k in range(LANG_CELLS)), *(f"source_{k}" for k in range(SOURCE_CELLS)))


def _content(text: Column) -> list[Column]:
    """The content view's measures; ``_words`` and ``_lines`` are columns."""
    words, chars = F.greatest(F.size("_words"), F.lit(1)), F.greatest(F.length(text), F.lit(1))
    gone = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    stop = F.filter("_words", lambda w: F.lower(F.rtrim(w, F.lit(EDGE_PUNCTUATION + SYMBOLS))).isin(*STOP_WORDS))
    return [
        (F.size(stop) / words).alias("stop_share"),
        F.least((F.length(text) - F.length(F.translate(text, SYMBOLS, ""))) / words, F.lit(2.0)).alias("symbol_share"),
        (gone("[A-Z]+") / chars).alias("capital_share"),
        (gone("[0-9]+") / chars).alias("digit_share"),
        (F.size(F.array_distinct("_words")) / F.sqrt(words)).alias("distinct_share"),
        (1 - F.size(F.array_distinct("_lines")) / F.greatest(F.size("_lines"), F.lit(1))).alias("repeated_lines"),
        F.least(F.length(text) / words, F.lit(40.0)).alias("word_length"),
    ]


def _cells(name: str, prefix: str, n: int) -> list[Column]:
    cell = F.pmod(F.crc32(F.coalesce(col(name).cast("string"), F.lit("\x00")).cast("binary")), F.lit(n))
    return [(cell == k).cast("double").alias(f"{prefix}_{k}") for k in range(n)]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             source_col: str = "source", chars_col: str = "n_chars", carry: dict[str, Column] | None = None) -> DataFrame:
    """``carry`` (a struct), ``id``, ``fold`` and both views' measures of every row."""
    known = col(chars_col).cast("double")
    size = F.greatest(F.coalesce(known, F.lit(-1.0)), F.lit(-1.0))
    magnitude = F.when(size >= 0, F.least(F.floor(F.log2(size + 1)), F.lit(CHARS_CELLS - 1)))
    meta = [F.log1p(F.greatest(size, F.lit(0.0))).alias("log_chars"), known.isNull().cast("double").alias("no_chars"),
            *[F.coalesce(magnitude == k, F.lit(False)).cast("double").alias(f"chars_{k}") for k in range(CHARS_CELLS)],
            *_cells(lang_col, "lang", LANG_CELLS), *_cells(source_col, "source", SOURCE_CELLS)]
    kept = F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in (carry or {"row": row_struct(docs)}).items()])
    t = docs.select(kept.alias("carry"), col(id_col).alias("id"), fold(id_col).alias("fold"), *meta, text_of(text_col).alias("_text"))
    t = t.withColumn("_words", words_of(F.col("_text"))).withColumn("_lines", F.array_remove(F.split("_text", "\n"), ""))
    return t.select("carry", "id", "fold", *META, *[c.cast("double").alias(n) for n, c in zip(CONTENT, _content(F.col("_text")))])


class View(NamedTuple):
    """One view's regression over standardised measures, with its calibration."""
    names: tuple[str, ...]
    weights: np.ndarray      # of the raw measures, then the constant

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]

    def column(self) -> Column:
        out = F.lit(float(self.weights[-1]))
        for n, w in zip(self.names, self.weights):
            out = out + float(w) * F.col(n)
        return out

    def scaled(self, by: np.ndarray) -> View:
        """The view whose log-odds are ``by[0]`` times these plus ``by[1]``."""
        w = self.weights * by[0]
        w[-1] += by[1]
        return View(self.names, w)


def _fit_view(names: tuple[str, ...], x: np.ndarray, y: np.ndarray) -> View:
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = np.inf                       # a constant measure tells nothing
    w = fit_logistic((x - mean) / spread, y, decay=1.0)
    raw = w[:-1] / spread
    return View(names, np.append(raw, w[-1] - raw @ mean))


class Model(NamedTuple):
    content: View | None
    meta: View | None
    blend: np.ndarray        # weights of the calibrated log-odds, then the constant
    taught: tuple[int, int] = (0, 0)     # pool rows labelled by the content and the metadata view


def _sure(view: View, x: np.ndarray, free: np.ndarray, share: float, per_round: int, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Free pool rows of which the view is surest, by rank and at most in the labels' proportion, and the labels
    it gives them: where its chance of error is at most ``sure`` times that of guessing by the labels' share."""
    p = 1 / (1 + np.exp(-np.clip(view.log_odds(x), -500, 500)))
    rows = np.flatnonzero(free)
    order = rows[np.argsort(p[rows], kind="stable")]
    n_good = int(round(per_round * share))
    good, bad = order[::-1][:n_good], order[:max(1, per_round - n_good)]
    good, bad = good[1 - p[good] <= sure * (1 - share)], bad[p[bad] <= sure * share]
    return np.concatenate([good, bad]), np.concatenate([np.ones(len(good)), np.zeros(len(bad))])


class Taught(NamedTuple):
    """Both views, and how many pool rows the content and the metadata view have labelled."""
    content: View
    meta: View
    by_content: int
    by_meta: int


def _calibrated(view: View, x: np.ndarray, y: np.ndarray) -> View:
    return view.scaled(fit_logistic(view.log_odds(x)[:, None], y, decay=1.0))


def co_train(xc: np.ndarray, xm: np.ndarray, y: np.ndarray, pool_c: np.ndarray, pool_m: np.ndarray, held: tuple[np.ndarray, ...] | None = None,
             rounds: int = ROUNDS, per_round: int = PER_ROUND, sure: float = SURE) -> Taught:
    """Both views after exchanging the pool rows they are sure of; ``held``: both views' measures and the labels of
    the rows that calibrate them before they choose."""
    share, free, given = float(y.mean()), np.ones(len(pool_c), bool), [0, 0]
    rows_c, y_c, rows_m, y_m = xc, y, xm, y
    for _ in range(rounds):
        content, meta = _fit_view(CONTENT, rows_c, y_c), _fit_view(META, rows_m, y_m)
        if held:
            content, meta = _calibrated(content, held[0], held[2]), _calibrated(meta, held[1], held[2])
        # the metadata view, the weaker one, chooses first: what both are sure of teaches the content view
        for_content, marks_c = _sure(meta, pool_m, free, share, per_round, sure)
        free[for_content] = False
        for_meta, marks_m = _sure(content, pool_c, free, share, per_round, sure)
        free[for_meta] = False
        if not len(for_meta) + len(for_content):
            break
        given = [given[0] + len(for_meta), given[1] + len(for_content)]
        rows_m, y_m = np.concatenate([rows_m, pool_m[for_meta]]), np.concatenate([y_m, marks_m])
        rows_c, y_c = np.concatenate([rows_c, pool_c[for_content]]), np.concatenate([y_c, marks_c])
    return Taught(_fit_view(CONTENT, rows_c, y_c), _fit_view(META, rows_m, y_m), *given)


def _matrix(rows: list, names: tuple[str, ...]) -> np.ndarray:
    return np.array([[r[n] for n in names] for r in rows], float).reshape(len(rows), len(names))


def fit(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
        max_labelled: int = MAX_LABELLED, max_pool: int = MAX_POOL) -> Model:
    """Co-train on a stored table of :func:`measured`; labels of fold 0 are never read."""
    marked = labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    marked = marked.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").select("id", "y")
    narrow = table.filter("fold > 0").select("id", "fold", *CONTENT, *META)
    known = least_by_hash(narrow.join(marked, "id"), "id", max_labelled).collect()
    unknown = narrow.join(labels.select(col(id_col).alias("id")), "id", "left_anti").filter("id IS NOT NULL")
    pool = least_by_hash(unknown, "id", max_pool).collect()
    train, held = [r for r in known if r["fold"] > 1], [r for r in known if r["fold"] == 1]
    y, y_held = (np.array([r["y"] for r in part], float) for part in (train, held))
    if len(set(y)) < 2 or len(set(y_held)) < 2:
        share = float(np.mean([r["y"] for r in known])) if known else 1.0
        return Model(None, None, np.array([0.0, 0.0, np.log(max(share, 1e-9) / max(1 - share, 1e-9))]))
    apart = (_matrix(held, CONTENT), _matrix(held, META), y_held)
    taught = co_train(_matrix(train, CONTENT), _matrix(train, META), y, _matrix(pool, CONTENT), _matrix(pool, META), apart)
    content, meta = (_calibrated(v, x, y_held) for v, x in zip(taught[:2], apart))
    both = np.column_stack([v.log_odds(x) for v, x in zip((content, meta), apart)])
    return Model(content, meta, fit_logistic(both, y_held, decay=1.0), taught[2:])


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(500.0)), F.lit(-500.0))))


def scored(table: DataFrame, model: Model) -> DataFrame:
    """``table`` with ``content_score``, ``meta_score`` and ``score``, the chance of a good document."""
    content, meta = (v.column() if v else F.lit(0.0) for v in (model.content, model.meta))
    a, b, c = map(float, model.blend)
    return table.withColumn("content_score", _sigmoid(content)).withColumn("meta_score", _sigmoid(meta)).withColumn(
        "score", _sigmoid(a * content + b * meta + c))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
             carry: dict[str, Column] | None = None, **columns: str) -> DataFrame:
    """One row per input row: the ``carry`` columns, ``held_out``, the views' scores, ``score`` and ``kept``."""
    carry = {"row": row_struct(docs)} if carry is None else carry
    table = stored(measured(docs, id_col, carry=carry, **columns), "measures")
    out = scored(table, fit(table, labels, id_col, label_col))
    return out.select(*[F.col("carry").getField(k).alias(k) for k in carry], (F.col("fold") == 0).alias("held_out"),
                      "content_score", "meta_score", "score", (F.col("score") >= 0.5).alias("kept"))
