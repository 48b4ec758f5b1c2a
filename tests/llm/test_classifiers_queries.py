"""Toxicity, the quality classifier, the registered queries and the pipeline."""

import hashlib
import itertools
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from touchline.llm import bpe, cotraining, mixing, queries, token_counts, toxicity
from tests.llm.conftest import edge_rows, prose
from tests.llm.test_rules_dedup_mix import brute_exact, brute_near, brute_verdict

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 1, 6, 2])
    u, moves = rng.normal(size=sizes.sum()), rng.normal(size=(2, 2))
    want, at = [], 0
    for n in sizes:
        weight, hot = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            s = np.exp(sum(u[at + t] for t in range(n) if y[t]) + sum(moves[y[t], y[t + 1]] for t in range(n - 1)))
            weight += s
            hot += s * np.array(y)
        want.append(hot / weight)
        at += n
    assert np.allclose(toxicity.marginals(u, moves, sizes), np.concatenate(want))


def test_chain_learns_to_tag_and_gives_offsets():
    clean = [([["the", f"w{k % 7}", "of", "it"]], 0) for k in range(60)]
    toxic = [([["the", "scum", f"w{k % 7}"], ["of", "it"]], 1) for k in range(30)]
    unary = toxicity._Unary(toxicity.fit_chain(clean + toxic))
    text = "the of it\n\n w1 SCUM*** scum! it"
    _, p = toxicity.judge([text, "", "the of it"], unary)
    assert [(s["start"], s["end"]) for s in toxicity.spans_of(text, p[0])] == [(15, 28)]
    assert not len(p[1]) and (p[2] < 0.5).all()


def auc(score, y):
    order = score.rank()
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_toxicity_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{LARGE}/labels.parquet")
    got = queries.QUERIES["op8_toxicity"](spark, LARGE).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all() and got.score.between(0, 1).all()
    assert auc(got.score, got.toxic) > 0.95
    assert ((got.predicted == 1) & (got.toxic == 0)).mean() < 0.02


def test_toxicity_edge_rows(spark, edge, empty):
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    rows = toxicity.tag(edge, toxicity.fit(edge, labels)).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    docs = [(k, prose(k, 40) + (" scum " if k % 3 == 0 else " ") + prose(k + 1000, 20)) for k in range(400)]
    train = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in docs], "doc_id long, toxic int")
    model = toxicity.fit(train, marks)
    rows = toxicity.tag(edge.unionByName(edge.limit(1).withColumn("text", F.lit("scum " * 4))), model).collect()
    assert [r["score"] > 0.5 for r in rows] == [r["row"]["text"] is not None and "scum" in r["row"]["text"] for r in rows]
    assert {r["row"]["kept"] for r in rows} == {"own kept"} and toxicity.tag(empty, model).count() == 0
    assert toxicity.tag(empty, toxicity.fit(empty, labels.limit(0))).count() == 0


def test_quality_classifier_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{LARGE}/labels.parquet")
    got = queries.QUERIES["op9_quality_classifier"](spark, LARGE).join(labels, "doc_id").filter("held_out").toPandas()
    assert auc(got.score, got.quality) > 0.97
    assert got.kept[got.quality == 1].mean() > 0.98


def test_both_views_teach_on_the_documents(spark):
    """Each view labels pool rows, rightly for the most part, and the content view doesn't lose by it."""
    from touchline.llm.common import stored
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    table = stored(cotraining.measured(docs), "measures")
    model = cotraining.fit(table, labels)
    assert min(model.taught) >= 20, model.taught
    got = cotraining.scored(table, model).filter("fold = 0").join(labels, table["id"] == labels["doc_id"]).select(
        "content_score", "meta_score", "score", "quality").toPandas()
    assert auc(got.meta_score, got.quality) > 0.5 and auc(got.content_score, got.quality) > 0.97
    assert auc(got.score, got.quality) >= auc(got.content_score, got.quality) - 0.005


def test_quality_classifier_edge_rows(spark, edge, empty):
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (None, 1), (8, None)], "doc_id long, quality int")
    rows = cotraining.classify(edge, labels).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["row"]["doc_id"] == 6}) == 1
    assert cotraining.classify(empty, labels.limit(0)).count() == 0
    assert all(r["kept"] for r in cotraining.classify(edge, labels.limit(0)).collect())


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 60).astype(float)
    pool = rng.integers(0, 2, 2000).astype(float)

    def view(of, names, noise):
        x = rng.normal(size=(len(of), len(names)))
        x[:, :2] += (2 * of[:, None] - 1) * noise
        return x
    xc, xm = view(y, cotraining.CONTENT, 2.0), view(y, cotraining.META, 2.0)
    pc, pm = view(pool, cotraining.CONTENT, 2.0), view(pool, cotraining.META, 2.0)
    _, meta, *taught = cotraining.co_train(xc, xm, y, pc, pm)
    assert min(taught) > 0
    alone = cotraining._fit_view(cotraining.META, xm, y)
    right = lambda v: ((v.log_odds(pm) > 0) == pool).mean()
    assert right(meta) >= right(alone) and right(meta) > 0.95


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES) - {"pipeline"}))
def test_query_matches_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SMALL)
    cur = con.execute(queries.ORACLES[name])
    names = sorted(d[0] for d in cur.description)
    assert sorted(got.columns) == names
    want = cur.fetchall()
    place = [[d[0] for d in cur.description].index(n) for n in names]
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(tuple(r[i] for i in place) for r in want)


def test_digest_queries_match_the_libraries(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    with open(public_tokenizers.path(queries.BPE_FILE), "rb") as f:
        enc = bpe.encoder(f.read(), public_tokenizers.PATTERN)
    for r in queries.QUERIES["op3_byte_bpe"](spark, SMALL).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    with open(public_tokenizers.path(queries.MODEL_FILE), "rb") as f:
        sp = token_counts.processor(f.read())
    for r in queries.QUERIES["op10_token_counts"](spark, SMALL).collect():
        n = len(sp.encode(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)
    from tests.llm.test_tokens_secrets_html import brute_spans
    for r in queries.QUERIES["op4_secret_scan"](spark, SMALL).collect():
        spans = brute_spans(texts[r["doc_id"]])
        base = [x for x in spans if x[0] in ("assign", "access", "hex")]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[0] == k for x in base) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert r["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {"pipeline", *(f"op{k}" for k in range(1, 14))}


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    rows = [r for r in rows if brute_verdict(r[1])[2]]
    kept = {(r[0], r[3]) for r in brute_exact(rows)}
    rows = [r for r in rows if (r[0], True) in kept]
    near = {r[0] for r in brute_near(rows) if r[3]}
    rows = [r for r in rows if r[0] in near]
    mixed = mixing.mix(spark.createDataFrame(rows, docs.schema), carry={"doc_id": F.col("doc_id")}).collect()
    copies = {r["doc_id"]: r["copies"] for r in mixed if r["copies"]}
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == [*docs.columns, "n_tokens", "ids", "round_trip"]
    got = out.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(copies)
    with open(public_tokenizers.path(corpus_pipeline.RANK_FILE), "rb") as f:
        enc = bpe.encoder(f.read(), public_tokenizers.PATTERN)
    assert all(r["round_trip"] and np.frombuffer(r["ids"], "<u4").tolist() == enc.encode_ordinary(r["text"]) for r in got)


def test_pipeline_stages_stand_edge_rows_and_empty_tables(spark, edge, empty):
    for docs in (edge, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            assert out.columns[:len(docs.columns)] == docs.columns
            assert (out.count() == 0) or docs is edge
