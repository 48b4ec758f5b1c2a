"""Licence scan by a positional index of rare words.

1. One scan takes each text's words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after
   lower-casing A-Z), the places of the base phrases, and which words of the licence
   vocabulary it holds. From the latter follow the document frequencies of that
   vocabulary over all rows.
2. Each notice is indexed by its ``anchors`` words of the highest inverse document
   frequency: postings of word, notice and place in the notice.
3. Texts that hold every word of some notice's key phrases are read again. Their words
   meet the postings; a hit's place less the posting's is where the notice would begin.
   Hits of one notice that agree on it up to ``slack`` words are counted, and so are the
   key phrases, whose places are postings too. A notice is found where at least
   ``percent`` of its postings and all its key phrases agree.

The index is as large as the notices, and so is the table of frequencies that is
gathered; texts are not cut, and hits are counted map-side before they are shuffled.
Texts are known by their SHA-256, so copies are one key; that key meets the rows by
broadcast up to ``broadcast_keys`` found texts, else in a join that is split where skewed.

``score`` is 1 with a base place, else the best found notice's share of agreeing
postings, else half the best share of any notice in a text that was read again, else 0.

Phrases and notices are ASCII. Defined results: a null text counts as empty, an empty
one has no words and no labels; rows that repeat an id or a text are judged alike; a
null id is carried through; an empty table gives an empty result; the input's columns
reach the result by ``carry`` only, so no name clashes.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of
from .licence_texts import BASE_PHRASES, TEMPLATES, Template

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANCHORS = 12               # rarest words of a notice that are indexed
PERCENT = 60               # of a notice's postings that must agree
SLACK = 8                  # words by which agreeing hits may be apart
BROADCAST_KEYS = 500_000   # texts with a result (some 100 bytes each) up to which they are broadcast


def ascii_words(text: str) -> list[str]:
    out = re.findall("[0-9a-z]+", text.lower())
    if not text.isascii() or not out:
        raise ValueError(f"phrases and notices are ASCII words: {text!r}")
    return out


def words_in(text: Column) -> Column:
    """The words of a text. The Kelvin sign is the one letter that lower-cases to an ASCII
    word by itself; another letter in its place keeps it from equalling a ``k``."""
    lowered = F.lower(F.replace(text, F.lit("K"), F.lit("Å")))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _list(words: Sequence[str]) -> str:
    return f"split('{' '.join(words)}', ' ')"


def _phrases(phrases: Sequence[tuple[Sequence[str], str]]) -> str:
    return f"array({', '.join(f"named_struct('words', {_list(w)}, 'tag', '{tag}')" for w, tag in phrases)})"


def _places(phrases: Sequence[tuple[Sequence[str], str]]) -> Column:
    """The places ``tag, pos`` of tagged phrases in ``words``, looked for only where all of a phrase's words are in ``has``."""
    if not phrases:
        return F.expr("cast(array() AS array<struct<tag:string,pos:int>>)")
    return F.expr(f"""flatten(transform(
        filter({_phrases(phrases)}, p -> size(array_except(p.words, has)) = 0),
        p -> transform(filter(sequence(0, size(words) - 1), i -> get(words, i) = p.words[0] AND slice(words, i + 1, size(p.words)) = p.words),
                       i -> named_struct('tag', p.tag, 'pos', i))))""")


def index(templates: Sequence[Template], frequency: dict[str, int], anchors: int = ANCHORS) -> tuple[list[tuple], list[tuple]]:
    """The postings ``token, notice, place, is_word`` and the notices ``notice, label, n_postings, n_phrases``."""
    postings, notices = [], []
    for t, (label, notice, key_phrases) in enumerate(templates):
        words = ascii_words(notice)
        rare = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))[:anchors]
        own = [(w, t, q, True) for q, w in enumerate(words) if w in rare]
        for phrase in map(ascii_words, key_phrases):
            q = next((q for q in range(len(words)) if words[q:q + len(phrase)] == phrase), None)
            if q is None:
                raise ValueError(f"{label}: the notice lacks its key phrase {' '.join(phrase)!r}")
            own.append((" ".join(["", *phrase]), t, q, False))
        postings += own
        notices.append((t, label, sum(p[3] for p in own), len(key_phrases)))
    return postings, notices


def scan(docs: DataFrame, text_col: str = "text", carry: dict[str, Column] | None = None,
         phrases: dict[str, str] | None = None, templates: Sequence[Template] = TEMPLATES, anchors: int = ANCHORS,
         percent: int = PERCENT, slack: int = SLACK, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row per input row: the ``carry`` columns (expressions over ``docs``), ``n_words``,
    ``n_base``, ``first_word``, ``last_word``, ``base_labels`` and ``labels`` (sorted arrays), ``score``."""
    spark, carry, phrases = docs.sparkSession, carry or {}, BASE_PHRASES if phrases is None else phrases
    base = [(ascii_words(p), label) for p, label in phrases.items()]
    keyed = [[ascii_words(p) for p in t.key_phrases] for t in templates]
    vocabulary = sorted({w for p, _ in base for w in p} | {w for t in templates for w in ascii_words(t.notice)})

    text, has = text_of(text_col), F.expr(f"array_intersect(words, {_list(vocabulary)})")
    key = F.unhex(F.sha2(text.cast("binary"), 256))
    df = docs.select(F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in carry.items()]).alias("carry"),
                     key.alias("key"), words_in(text).alias("words")).withColumn("has", has)
    rows = stored(df.select("carry", "key", F.size("words").cast("long").alias("n_words"), "has", _places(base).alias("places")), "rows")

    held = rows.select(F.explode("has").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    postings, notices = index(templates, {r["word"]: r["n"] for r in held.collect()}, anchors)   # a row a word of the vocabulary

    of_notice = _phrases([(sorted({w for p in of for w in p}), "") for of in keyed])
    keys = rows.filter(F.expr(f"exists({of_notice}, n -> size(array_except(n.words, has)) = 0)")).select("key").distinct() if keyed \
        else rows.select("key").limit(0)
    keys = stored(keys, "keys")
    few = F.broadcast if keys.count() <= broadcast_keys else lambda x: x

    again = docs.select(key.alias("key"), text.alias("text")).join(few(keys), "key", "left_semi").select("key", words_in(F.col("text")).alias("words"))
    token = lambda p: " ".join(["", *p])  # noqa: E731  begins with a space, as no word does
    tokens = F.concat(F.expr("transform(words, (w, i) -> named_struct('tag', w, 'pos', i))"),
                      _places([(p, token(p)) for p in sorted({tuple(p) for of in keyed for p in of})]))
    hits = again.withColumn("has", has).select("key", F.explode(tokens).alias("token")).select("key", F.col("token.tag").alias("token"), "token.pos")
    of_token = F.broadcast(spark.createDataFrame(postings, "token string, notice int, place int, is_word boolean"))   # as large as the notices
    begin = F.floor((F.col("pos") - F.col("place")) / slack).cast("long")
    votes = hits.join(of_token, "token").select(
        "key", "notice", "place", "is_word", F.explode(F.array(begin, begin + 1)).alias("begin"))
    agreed = votes.distinct().groupBy("key", "notice", "begin").agg(
        F.sum(F.col("is_word").cast("int")).alias("words"), F.sum((~F.col("is_word")).cast("int")).alias("phrases"))
    of_notice = F.broadcast(spark.createDataFrame(notices, "notice int, label string, n_postings int, n_phrases int"))
    judged = agreed.join(of_notice, "notice").withColumn("part", F.col("words") / F.col("n_postings")).withColumn(
        "found", (F.col("phrases") == F.col("n_phrases")) & (100 * F.col("words") >= percent * F.col("n_postings")))
    of_text = stored(judged.groupBy("key").agg(
        F.array_sort(F.collect_set(F.when(F.col("found"), F.col("label")))).alias("found"),       # at most as many as notices
        F.max(F.when(F.col("found"), F.col("part")).otherwise(F.col("part") / 2)).alias("part")), "found")

    out = rows.join(few(of_text), "key", "left")
    labels = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["tag"])))
    every = F.array_sort(F.array_union(labels, F.coalesce("found", F.array().cast("array<string>"))))
    at = F.transform("places", lambda p: p["pos"])
    return out.select(
        *[F.col("carry").getField(k).alias(k) for k in carry], "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        labels.alias("base_labels"), every.alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("part", F.lit(0.0))).alias("score"))
