"""Byte-level BPE, token counts, secret scan and HTML extraction against the libraries and brute force."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from touchline.llm import bpe, html_text, secrets, token_counts
from tests.llm.conftest import edge_rows, prose

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def bpe_encoder():
    with open(RANKS, "rb") as f:
        return bpe.encoder(f.read(), public_tokenizers.PATTERN)


def test_bpe_ids_and_round_trip(edge, empty):
    enc = bpe_encoder()
    out = bpe.decode(bpe.encode(edge, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    rows = out.select("row.text", "ids", "decoded", "row.kept").collect()
    assert len(rows) == len(edge_rows()) and {r["kept"] for r in rows} == {"own kept"}
    for r in rows:
        text = r["text"] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == enc.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
    both = bpe.encode(edge, RANKS, public_tokenizers.PATTERN, decoded=True).select("row.text", "ids", "decoded").collect()
    assert sorted((r["text"] or "", bytes(r["ids"]), bytes(r["decoded"])) for r in both) == sorted(
        (r["text"] or "", bytes(r["ids"]), bytes(r["decoded"])) for r in rows)
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_pieces_concatenate_to_the_whole():
    enc, rng = bpe_encoder(), random.Random(1)
    bits = ["word", " ", "  ", "\n", "\t", "'s", "'", "12", "é", "日本", "...", "　", "don't", "\r\n", "😀", "\x1c"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(60)))
        cut = list(bpe.pieces(text, 7))
        assert "".join(cut) == text
        assert bpe.encode_text(enc, text, 7).tolist() == enc.encode_ordinary(text), text


def test_bpe_decodes_ids_that_are_no_text(spark):
    df = spark.createDataFrame([(bytearray(np.array([200, 150], "<u4").tobytes()),), (None,)], "ids binary")
    got = [r["decoded"] for r in bpe.decode(df, RANKS, public_tokenizers.PATTERN).collect()]
    assert got == [bytearray(bpe_encoder().decode_bytes([200, 150])), None]


def sentencepiece():
    with open(MODEL, "rb") as f:
        return token_counts.processor(f.read())


def test_token_counts_match_the_library(edge, empty):
    sp = sentencepiece()
    for table_size in (token_counts.TABLE_SIZE, 3):
        out = token_counts.count_tokens(edge, MODEL, table_size=table_size, cache_size=5).select("row.text", "n_bytes", "n_tokens")
        rows = out.collect()
        assert len(rows) == len(edge_rows())
        for r in rows:
            text = r["text"] or ""
            assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(sp.encode(text))), text[:50]
    assert token_counts.count_tokens(empty, MODEL).count() == 0


def test_token_table_is_counted_on_all_whole_texts(spark, monkeypatch):
    rows = [(f"short{i} rare",) for i in range(3000)] + [("common " * 9000,), (None,), ("x" * 500,)]
    docs = spark.createDataFrame(rows, "text string").repartition(4)
    sp, sent, send = sentencepiece(), [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(value) or send(value))
    for cache_size in (token_counts.CACHE_SIZE, 5):
        out = token_counts.count_tokens(docs, MODEL, table_size=2, cache_size=cache_size)
        assert sent[-1] == {"▁common": len(sp.encode("common")), "▁rare": len(sp.encode("rare"))}
        assert sorted(r["n_tokens"] for r in out.collect()) == sorted(len(sp.encode(t or "")) for t, in rows)


def test_pre_token_lengths_add_up():
    sp, rng = sentencepiece(), random.Random(2)
    lengths = token_counts.Lengths(sp, {}, 1000)
    bits = ["hello", " ", "  ", "\n", "\t", "▁", "world", "é", "日本", "<s>", "</s>", "<unk>", "　", "\xa0", "1", "23", "\x00", "😀", "     ", " \n "]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert lengths.count(text) == len(sp.encode(text)), text


BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    "github": (re.compile(r"gh[pousr]_[A-Za-z0-9]+"), lambda m: len(m[0]) >= 40),
    "slack": (re.compile(r"xox[abprs]-[A-Za-z0-9-]+"), lambda m: len(m[0]) >= 15),
    "pem": (re.compile(r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----+"), lambda m: m[0].endswith("KEY-----") and not m[0].endswith("KEY------")),
}
ORDER = [r.kind for r in secrets.RULES]


def brute_spans(text):
    found = [(m.start(), ORDER.index(k), m.end()) for k, (p, ok) in BASE.items() for m in p.finditer(text or "") if ok(m)]
    return [(ORDER[k], s, e) for s, k, e in sorted(found)]


def test_secret_spans_match_the_regexes(edge, empty):
    rows = secrets.find_secrets(edge).select("row.text", "spans").collect()
    assert len(rows) == len(edge_rows()) and sum(len(r["spans"]) for r in rows) >= 3
    for r in rows:
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == brute_spans(r["text"])
    assert secrets.find_secrets(empty).count() == 0


@pytest.mark.parametrize("lane", [16, 1 << 11])
def test_secret_scan_on_random_texts(monkeypatch, lane):
    monkeypatch.setattr(secrets, "LANE_BYTES", lane)
    rng = random.Random(5)
    bits = ["password", "Secret", "api_key", "apikey", "ToKen", "=", ":", " ", '"', "'", "AKIA", "abc0123456789def", "ABCDEFGH12345678", "é", "\n",
            "x", "passwd", "pass", "tok", "abcdefghijkl", ".", "-", "_", "0", "f", "g", "--", "ghp_", "xoxb-", "-----BEGIN ", "RSA ", "PRIVATE KEY", "-----", ";"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(50))) for _ in range(8000)]
    coded = [t.encode() for t in texts]
    for text, raw, spans in zip(texts, coded, secrets.scan(coded)):
        assert [(ORDER[k], s, e) for s, k, e in secrets.in_code_points(raw, spans)] == brute_spans(text), text


def test_automaton_is_minimal_and_starts_at_zero():
    auto = secrets.compiled(secrets.RULES)
    n = len(auto.labels)
    assert auto.labels[0] == 0 and auto.table.max() < n and auto.resets[ord("\n")]
    rows = auto.table.reshape(n, -1)
    block = auto.labels.astype(int)
    for _ in range(n):
        block = np.unique(np.column_stack([block, block[rows]]), axis=0, return_inverse=True)[1]
    assert len(set(block)) == n


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}<style>p{{}}</style></head><body>{body}</body></html>"


PROSE = ["This is the first of the paragraphs and it is here for the words that are usual in prose of the kind that is read.",
         "There is another one of the kind in the middle of it, and it was made for the same end as the first of them.",
         "That is the last of the paragraphs that are in the article, and with it the text of the page is at an end."]


def ps(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


@pytest.mark.parametrize("body, want", [
    (f"<nav><a href=x>Home</a></nav><article><h1>Title &amp; more</h1>{ps(*PROSE)}</article><footer>&copy; all</footer>", ["Title & more", *PROSE]),
    (f"<article>{ps('Yes.', PROSE[0], 'No.')}<aside>{PROSE[1]}</aside><form>{PROSE[2]}</form></article>", ["Yes.", PROSE[0], "No."]),
    ("<article><p>Only this.</p></article><div class='ad'>Buy it</div>", ["Only this."]),
    (f"<div id=content>{ps(*PROSE)}</div><div class='cookie-notice'>{PROSE[0]}</div><section id=comments><article class=comment>{ps(PROSE[1])}</article></section>", PROSE),
    (f"<ul><li><a href=a>One</a><li><a href=b>Two</a></ul>{ps(PROSE[0], 'Short.', PROSE[1])}<p>Copyright</p>", [PROSE[0], "Short.", PROSE[1]]),
    (f"<header><h2>Site</h2></header><main><p><b>{PROSE[0]}<br><p>{PROSE[1]}</main><script>if (a < b) '</p>'</script>", PROSE[:2]),
    ("<article><p>a&nbsp;&lt;b&gt; &#233;\n\n c &eacute; &am</p></article>", ["a <b> é c é &am"]),
    (f"<article>{ps(PROSE[0])}<!-- a comment --><p hidden>{PROSE[1]}</p><div class='related-links'>{PROSE[2]}</div>", [PROSE[0]]),
    ("<nav><a href=x>Home</a></nav>", []), ("", []), ("<", []), ("<article><p>cut of", ["cut of"]),
    ("<table><tr><td>" + PROSE[0] + "<td>" + PROSE[1] + "</table>", PROSE[:2]),
    ("<article><table><tr><td>1<td>2</table></article>", ["1", "2"]),
    (f"<div class='layout has-sidebar'><div id='cookiebar'>{PROSE[0]}</div><main>{ps(*PROSE)}</main><ins class='adsbygoogle'>{PROSE[1]}</ins></div>", PROSE),
])
def test_main_text(body, want):
    got = html_text.main_text(page(body))
    assert got == "\n\n".join(want)


def test_extract_keeps_rows(spark):
    rows = [(1, "u", page(f"<article>{ps(*PROSE)}</article>")), (2, None, None), (3, "u", ""), (3, "u", ""), (None, "v", "plain <b>text"),
            (4, "u", page(f"<article>{ps(*[prose(k, 40) for k in range(3000)])}</article>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own")).withColumn("row", F.lit(1))
    got = {(r["row"]["page_id"], r["row"]["text"]): r["text"] for r in html_text.extract(df).collect()}
    assert len(got) == 5 and got[1, "own"] == "\n\n".join(PROSE) and got[2, "own"] == "" == got[3, "own"]
    assert got[4, "own"].count("\n\n") == 2999
    assert html_text.extract(df.limit(0)).count() == 0


def test_extract_on_the_pages_table(spark):
    import html
    rows = html_text.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).select("row.html", "text").collect()
    for r in rows:                                        # these pages mark their article plainly
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", inner)]
        assert r["text"] == "\n\n".join(p for p in parts if p)
