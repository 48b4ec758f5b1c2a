"""Quality rules: a threshold table compiled into one projection.

Every rule is a row of :data:`RULES`: a ratio of two text measures and the
interval it must lie in. :func:`measures` computes the measures of a text with
built-in functions only, :func:`verdict` turns the table into one boolean
expression. There is no shuffle: a row is judged by itself, in the scan's stage.

Defined results: a null text counts as empty; an empty or blank text has no
words and fails; equal rows get equal verdicts; an empty table gives an empty
result; the input's own columns are carried in a struct, so clashing names are safe.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, row_struct, text_of, unpack, words_of

# Fixed values of the base rule.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Frequent function words of the corpus languages (English, German, French, Spanish).
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that",
    "the", "this", "to", "was", "with",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "ich", "im", "ist", "mit", "nicht",
    "sich", "sie", "und", "von", "zu",
    "avec", "ce", "dans", "de", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "par", "pas", "pour",
    "que", "qui", "sur", "un", "une",
    "al", "con", "del", "el", "las", "lo", "los", "no", "por", "se", "su", "y",
)
EDGE_PUNCTUATION = ".,;:!?"


class Rule(NamedTuple):
    name: str
    over: str            # measure above the line
    under: str           # measure below the line (at least 1 is used)
    low: float
    high: float


# The threshold table: a text passes when every ratio lies in [low, high].
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbol_ratio", "n_symbols", "n_words", 0.0, 0.2),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.02, 1.0),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", 0.0, 0.5),
    Rule("bullet_line_ratio", "n_bullet_lines", "n_lines", 0.0, 0.9),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines", "n_lines", 0.0, 0.5),
)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines")


def _repeat_words(windows: Column) -> Column:
    """Words covered by a three-word window that is found twice or more: the sorted
    windows put equal ones side by side, so each looks only at its neighbours."""
    def twice(x, j):
        return (F.get(windows, j - 1)["w"].eqNullSafe(x["w"])
                | F.get(windows, j + 1)["w"].eqNullSafe(x["w"]))
    starts = F.transform(F.filter(windows, twice), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
    return F.size(F.array_distinct(F.flatten(starts))).cast("long")


def measures(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with the measures of ``text`` added under their own names
    (long). Call it on a frame whose own columns are packed away."""
    t = df.withColumn("_text", text)
    t = t.withColumn("_words", words_of(F.col("_text")))
    t = t.withColumn("_lines", F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(WORD_CLASS)))
    n = F.size("_words")
    t = t.withColumn("_windows", F.sort_array(F.transform(
        F.slice("_words", F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.struct(F.concat_ws(" ", w, F.get("_words", i + 1), F.get("_words", i + 2)).alias("w"),
                              i.alias("i")))))
    stop = F.filter("_words", lambda w: F.lower(F.rtrim(w, F.lit(EDGE_PUNCTUATION))).isin(*STOP_WORDS))
    found = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", SPACE_CLASS + "+", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_windows")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(stop).cast("long").alias("n_stop_words"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
    )
    # a filter on the verdict stays above explode(); pushed below, it would repeat the work for each use of a measure
    return t.select(*df.columns, F.explode(F.array(found)).alias("_m")).select(*df.columns, "_m.*")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression over the measures."""
    ok = ~base_failed()
    for r in rules:
        under = F.greatest(F.col(r.under), F.lit(1))
        ok = ok & (F.col(r.over) >= r.low * under) & (F.col(r.over) <= r.high * under)
    return ok


def apply_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: ``row`` (the input row), the measures, ``base_failed`` and ``kept``."""
    packed = docs.select(row_struct(docs).alias("row"), text_of(text_col).alias("_in"))
    m = measures(packed, F.col("_in")).drop("_in")
    return m.withColumn("base_failed", base_failed()).withColumn("kept", verdict(rules))


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The input rows that pass, with their own columns."""
    out = apply_rules(docs, text_col, rules).filter("kept")
    return out.select(*unpack(out, "row", docs.columns))
