"""The licence scan against brute force."""

import re
from collections import Counter

import pytest

from touchline.llm import licences
from touchline.llm.licence_texts import BASE_PHRASES, TEMPLATES, Template
from tests.llm.conftest import edge_rows, prose
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def places(words, phrase):
    return [i for i in range(len(words)) if words[i:i + len(phrase)] == phrase]


def brute(texts, phrases=BASE_PHRASES, templates=TEMPLATES, anchors=licences.ANCHORS, percent=licences.PERCENT, slack=licences.SLACK):
    docs = [words_of(t) for t in texts]
    df = Counter(w for d in docs for w in set(d))
    out = []
    for d in docs:
        base = [(i, label) for p, label in phrases.items() for i in places(d, words_of(p))]
        labels, part = {x for _, x in base}, 0.0
        read = any(set(w for p in t.key_phrases for w in words_of(p)) <= set(d) for t in templates)
        for t in templates if read else ():
            notice = words_of(t.notice)
            rare = sorted(set(notice), key=lambda w: (df[w], w))[:anchors]
            own = [(q, w) for q, w in enumerate(notice) if w in rare]
            votes = {(i - q) // slack + k: set() for q, w in own for i in places(d, [w]) for k in (0, 1)}
            for q, w in own:
                for i in places(d, [w]):
                    votes[(i - q) // slack].add(q), votes[(i - q) // slack + 1].add(q)
            for b, agree in votes.items():
                there = all(any((i - places(notice, words_of(p))[0]) // slack in (b, b - 1) for i in places(d, words_of(p))) for p in t.key_phrases)
                found = there and 100 * len(agree) >= percent * len(own)
                part = max(part, len(agree) / len(own) / (1 if found else 2))
                labels |= {t.label} if found else set()
        at = [i for i, _ in base]
        out.append((len(d), len(base), min(at, default=None), max(at, default=None), sorted({x for _, x in base}), sorted(labels),
                    1.0 if base else part))
    return out


def run(df, **params):
    got = licences.scan(df, carry={"doc_id": F.col("doc_id"), "t": F.col("text")}, **params).collect()
    return Counter((r["doc_id"], r["t"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], tuple(r["base_labels"]),
                    tuple(r["labels"]), r["score"]) for r in got)


def want(rows, **params):
    texts = [r[1] for r in rows]
    return Counter((r[0], r[1], *b[:4], tuple(b[4]), tuple(b[5]), b[6]) for r, b in zip(rows, brute(texts, **params)))


TEXTS = [
    *(f"{prose(k, 30)} {t.notice} {prose(k + 50, 20)}" for k, t in enumerate(TEMPLATES)),
    *(t.notice.upper().replace(" ", "\n *  ") for t in TEMPLATES),
    "Under the MIT-License, under the mit license under the mit license", "UNDER the\x00mit ﬁlicense, under thé mit license",
    "cc by nc cc-by-nc 4.0 CC BY NC", "apache license, version 2.0", "apache license, version", "The Apache\tLicense, Version 2!",
    "gnu general public license version 3", "version 3 of public license, a general gnu", "work licensed under gnu general public license " + "x " * 60 + "version 3",
    "licensed under this work the GNU General Public License, version 3 it is", "creative commons ATTRIBUTION 4.0 intl.", "MİT Key éé",
    TEMPLATES[6].notice.replace("software", "works"), " ".join(TEMPLATES[6].notice.split()[::2]), TEMPLATES[2].notice.replace("GNU", "[the] GNU"),
    prose(9, 3000) + TEMPLATES[9].notice + prose(10, 3000) + TEMPLATES[6].notice]


@pytest.mark.parametrize("params", [{}, {"broadcast_keys": 0}, {"anchors": 3, "percent": 100, "slack": 2}])
def test_scan_matches_brute_force(spark, params):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, TEXTS[0]), (3, TEXTS[3]), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = run(df, **params)
    assert got == want(rows, **{k: v for k, v in params.items() if k != "broadcast_keys"})
    if not params:
        labels = {r[0]: r[7] for r in got if r[0] is not None and r[1] is not None}
        assert all(t.label in labels[k] and t.label in labels[k + len(TEMPLATES)] for k, t in enumerate(TEMPLATES))


def test_scan_of_edge_rows_and_empty_tables(edge, empty):
    assert run(edge) == want([(r[0], r[1]) for r in edge_rows()])
    assert licences.scan(empty).count() == 0


def test_phrases_and_notices_are_parameters(spark):
    rows = [(1, "a b a b a"), (2, "b a"), (3, "one two three four five six"), (4, "")]
    own = (Template("count", "one two three four", ("two three",)),)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df, phrases={"a b a": "x"}, templates=own) == want(rows, phrases={"a b a": "x"}, templates=own)
    assert run(df, phrases={}, templates=()) == want(rows, phrases={}, templates=())
    with pytest.raises(ValueError):
        licences.index([Template("x", "a notice", ("lacking",))], {})
