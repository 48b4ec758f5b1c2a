"""Quality rules, exact dedup, MinHash near-dedup, components and mixing against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from touchline.llm import components, exact_dedup, minhash, mixing, quality_rules, shingles
from tests.llm.conftest import edge_rows, prose

WORD, SPACE = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {k for i, w in enumerate(windows) if count[w] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def brute_verdict(text):
    n, _, symbols, _, repeats = base = brute_base(text)
    if n < 50 or 100 * repeats > 50 * n:
        return base, True, False
    lines = [x for x in text.split("\n") if WORD.search(x)]
    words = WORD.findall(text)
    m = dict(zip(quality_rules.BASE, base), n_lines=len(lines),
             n_stop_words=sum(w.rstrip(quality_rules.EDGE_PUNCTUATION).lower() in quality_rules.STOP_WORDS for w in words),
             n_bullet_lines=sum(x.lstrip(" \t\x0b\x0c\r")[:1] in ("-", "*", "•") for x in lines),
             n_ellipsis_lines=sum(x.rstrip(" \t\x0b\x0c\r").endswith(("...", "…")) for x in lines))
    return base, False, all(r.low * max(m[r.under], 1) <= m[r.over] <= r.high * max(m[r.under], 1) for r in quality_rules.RULES)


def test_quality_rules_match_brute_force(edge, empty):
    got = quality_rules.apply_rules(edge).select("row.text", *quality_rules.BASE, "base_failed", "kept").collect()
    assert len(got) == len(edge_rows())
    for r in got:
        base, failed, kept = brute_verdict(r["text"])
        assert (tuple(r[c] for c in quality_rules.BASE), r["base_failed"], r["kept"]) == (base, failed, kept), (r["text"] or "")[:50]
    assert quality_rules.apply_rules(empty).count() == 0


@pytest.mark.parametrize("text", [
    "- a line of the list\n" * 30, "the end is near...\n" * 30, "the and of " * 40, prose(5, 80) + " ### $$$ *** %%% &&&" * 9,
    prose(6, 49), prose(7, 50), "\n".join(prose(k, 12) for k in range(9)), "\n".join([prose(8, 30)] * 2)])
def test_quality_rules_each_rule(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = quality_rules.apply_rules(df).select(*quality_rules.BASE, "base_failed", "kept").first()
    assert (tuple(r[:5]), r[5], r[6]) == brute_verdict(text)


def test_keep_good_returns_the_input_columns(edge):
    out = quality_rules.keep_good(edge)
    assert out.columns == edge.columns and {r["doc_id"] for r in out.collect()} == {
        r[0] for r in edge_rows() if brute_verdict(r[1])[2]}


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[SPACE.sub(" ", r[1] or "")].append(r[0])
    out = []
    for r in rows:
        g = groups[SPACE.sub(" ", r[1] or "")]
        keep = min((x for x in g if x is not None), default=None)
        out.append((r[0], keep, len(g), r[0] == keep, hashlib.sha256(SPACE.sub(" ", r[1] or "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("broadcast_groups, prefix", [(10**6, 256), (0, 256), (10**6, 1)])
def test_exact_groups_match_brute_force(edge, empty, broadcast_groups, prefix):
    digest = exact_dedup.full_hash(exact_dedup.normalised(F.coalesce("text", F.lit(""))))
    got = exact_dedup.exact_groups(edge, carry={"sha": digest}, broadcast_groups=broadcast_groups, prefix_chars=prefix)
    rows = [(r["id"], r["keep_id"], r["group_size"], r["kept"], r["sha"]) for r in got.collect()]
    assert Counter(rows) == Counter(brute_exact(edge_rows()))
    assert exact_dedup.exact_groups(empty).count() == 0


def test_drop_copies_keeps_one_row_of_each_text(edge):
    out = exact_dedup.drop_copies(edge)
    assert out.columns == edge.columns
    texts = [SPACE.sub(" ", r["text"] or "") for r in out.collect()]
    assert Counter(texts).keys() == {SPACE.sub(" ", r[1] or "") for r in edge_rows()}
    assert all(n == 1 for t, n in Counter(texts).items() if t != "no id")


def brute_sets(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    k = min(5, len(words))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def brute_near(rows):
    sets = [brute_sets(r[1]) for r in rows]
    ids = [r[0] for r in rows]
    parent = {i: i for i in ids if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and None not in (ids[i], ids[j]) and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(ids[i]), root(ids[j])))
                parent[y] = x
    return [(i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in zip(ids, sets)]


def rows_of(df):
    return Counter((r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


@pytest.mark.parametrize("broadcast_ids", [10**6, 0])
def test_near_components_match_brute_force_on_edge_rows(edge, empty, broadcast_ids):
    assert rows_of(minhash.near_components(edge, broadcast_ids=broadcast_ids)) == Counter(brute_near(edge_rows()))
    assert minhash.near_components(empty).count() == 0


def edited(rng, base, n):
    words = base.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_components_match_brute_force_on_groups_of_edited_copies(spark):
    rng = random.Random(4)
    texts = []
    for g in range(6):                                    # copies with few to many edits, so that links pass through others
        base = prose(100 + g, 300)
        texts += [edited(rng, base, rng.randrange(0, 16)) for _ in range(60 if g == 0 else 12)]
    texts += [prose(200 + k, 120) + " " + prose(99, 60) for k in range(40)]      # a passage that many share
    texts += texts[:20]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(brute_near(rows))
    assert rows_of(minhash.near_components(df)) == want
    assert rows_of(minhash.near_components(df, small_bucket=4)) == want           # by rounds of pivots
    assert rows_of(minhash.near_components(df, small_bucket=4, rounds=1, hot_shingle=5)) == want
    kept = minhash.drop_near_copies(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in want if r[3]}


def test_near_copies_are_dropped_by_text_not_by_id(spark):
    """An id on two texts is two documents: dropping one of them leaves the other."""
    a, b, c = prose(400, 80), prose(401, 80), prose(402, 80)
    rows = [(1, a, "s"), (2, a + " end", "s"), (2, b, "s"), (4, b + " end", "s"), (5, c, "s"), (5, c, "s"), (5, c + " end", "s"), (None, c + " x", "s"),
            (None, prose(403, 80), "s"), (6, None, "s"), (7, "", "s"), (7, "  ", "s"), (8, prose(404, 80), "s"), (8, prose(405, 80), "s"), (8, prose(405, 80), "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for params in ({}, {"broadcast_ids": 0}):
        got = [tuple(r) for r in minhash.drop_near_copies(df, **params).collect()]
        sets = [brute_sets(t) for _, t, _ in got]
        like = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
        assert not any(x and like(x, y) for i, x in enumerate(sets) for y in sets[:i])           # no two of one group
        for _, t, _ in rows:                                                                       # nothing of any group is lost
            s = brute_sets(t)
            assert any(like(s, x) for x in sets) if s else (t in [x for _, x, _ in got])
        assert sorted(r[0] or 0 for r in got) == [0, 1, 2, 5, 6, 7, 7, 8, 8]
        assert sorted(r[1] for r in got if r[0] == 7) == ["", "  "]


def form_letters(n, twins, edits=0):
    """Texts of mutual similarity 0.72 (less with edits), where the first ``twins`` pairs share eight more words and have 0.76."""
    rng, form = random.Random(11), prose(300, 200)
    body = lambda k: " ".join(f"b{rng.randrange(10**9)}" for _ in range(k))
    texts = []
    for k in range(n):
        if k < 2 * twins and k % 2 == 0:
            own = body(8)
        texts.append(f"{edited(rng, form, edits)} {own if k < 2 * twins else body(8)} {body(31)}")
    return texts


@pytest.mark.parametrize("params", [{}, {"hot_shingle": 7, "broadcast_shingles": 0}])
def test_near_components_finds_the_near_pairs_of_a_template_family(spark, params):
    texts = form_letters(300, 60)
    rows = list(enumerate(texts))
    sets = [brute_sets(t) for t in texts]
    like = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert 0.7 < like(0, 2) < 0.74 and 0.75 < like(0, 1) < 0.77
    want = Counter(brute_near(rows))
    assert sum(not r[3] for r in want) == 60
    assert rows_of(minhash.near_components(spark.createDataFrame(rows, "doc_id long, text string"), **params)) == want


def test_links_with_few_equal_minima_are_confirmed(spark):
    reps = spark.createDataFrame([(1, [0] * 128), (2, [0] * 70 + [1] * 58), (3, [0] * 60 + [2] * 68)], "id long, sig array<int>")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    linker = minhash._Linker(None, reps, 5, 75, minhash.SIGNATURE_FLOOR, 0)
    assert [tuple(r) for r in linker.alike(pairs).collect()] == [(1, 2)]


@pytest.mark.parametrize("hot", [3, 512])
def test_front_pairs_hold_all_links_between_components(spark, hot):
    rng, base = random.Random(12), prose(301, 150)
    texts = [edited(rng, base, rng.randrange(0, 9)) + " " + prose(k, rng.randrange(1, 40)) for k in range(90)] + form_letters(40, 9, 1)
    sets = [brute_sets(t) for t in texts]
    root = [k % 7 for k in range(len(texts))]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if root[i] != root[j]
            and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    hashed = [[int(x) for x in s.view("int64")] for s in shingles.shingle_sets(pa.array(texts))]
    df = spark.createDataFrame([(k, root[k], s) for k, s in enumerate(hashed)], "id long, root long, shingles array<long>")
    got = {(r["a"], r["b"]) for r in minhash._front_pairs(df, 75, hot).collect()}
    assert want and want <= got and all(i < j and root[i] != root[j] for i, j in got)


def test_shingles_of_long_texts_are_cut_at_white_space(monkeypatch):
    import pyarrow as pa
    texts = pa.array([prose(1, 500), None, "", "x" * 5000 + " a b c d e", "A b\tC d e f " * 50])
    whole = [s.tolist() for s in shingles.shingle_sets(texts)]
    monkeypatch.setattr(shingles, "CHUNK_BYTES", 64)
    assert [s.tolist() for s in shingles.shingle_sets(texts)] == whole
    assert [len(s) for s in whole] == [len(brute_sets(t)) for t in texts.to_pylist()]
    assert [s.tolist() for s in shingles.shingle_sets(texts.slice(3))] == whole[3:]


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(1000, 1030)] + [
        (2000, k) for k in range(2001, 2060)] + [(5, 5), (None, 3)]
    parent = {x: x for e in edges for x in e if x is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["leaf"]: r["root"] for r in components.connected_components(df).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:                                          # share, stop the full, share the excess again
        level = rest / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level >= 3 * sizes[s]}
        if not full:
            return target | {s: w[s] * level for s in open_}
        for s in full:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
        open_ -= full
    return target


def brute_expected(words, target, weigh=lambda n: n.bit_length() or 1, most=3):
    """Expected copies of each of a source's documents: by weight, the limited ones taken out until none is above."""
    full, weight = set(), [max(1, weigh(n)) for n in words]
    while True:
        rest = sum(weight[k] * n for k, n in enumerate(words) if k not in full)
        factor = (target - most * sum(words[k] for k in full)) / rest if rest else 0.0
        more = {k for k in range(len(words)) if k not in full and factor * weight[k] >= most}
        if not more or not rest:
            return [float(most) if k in full else factor * weight[k] for k in range(len(words))]
        full |= more


@pytest.mark.parametrize("broadcast_sources", [10**5, 0])
def test_mixing_meets_its_targets(spark, edge, empty, broadcast_sources):
    rng = random.Random(9)
    rows = [(k, prose(k, rng.randrange(1, 120)), rng.choice("aaaaabbbcdef") if k % 50 else None) for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    carry = {"doc_id": F.col("doc_id"), "source": F.col("source")}
    run = lambda: sorted(map(tuple, mixing.mix(df, carry=carry, broadcast_sources=broadcast_sources).collect()))
    got = run()
    assert got == run() and len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    want, taken = brute_targets(size), Counter()
    for doc, s, n, source_size, target, copies in got:
        assert n == len(rows[doc][1].split()) and source_size == size[s] and abs(target - want[s]) < 1e-6 and copies <= 3
        taken[s] += n * copies
    for s in size:
        own = [r for r in got if r[1] == s]
        expected = brute_expected([r[2] for r in own], want[s])
        assert all(int(e + 1e-9) <= r[5] <= int(e - 1e-9) + 1 for e, r in zip(expected, own))
    assert all(abs(taken[s] - want[s]) <= 60 for s in size)          # half the largest document
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(edge).count() == len(edge_rows())


def test_mixed_rows_repeat_whole_rows(edge):
    copies = Counter()
    for r in mixing.mix(edge, carry={"doc_id": F.col("doc_id"), "text": F.col("text")}).collect():
        copies[r["doc_id"], r["text"]] += r["copies"]
    out = mixing.mixed_rows(edge)
    assert out.columns == edge.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == +copies


def test_mixing_draws_follow_unequal_chances(spark):
    """Over many sources of the same sizes, each weight's copies come near what its chance asks for."""
    sizes = [1, 2, 3, 5, 6, 9, 12, 17, 20, 33, 40, 70] * 4
    df = spark.range(60).select(F.concat(F.lit("s"), "id").alias("source"), F.posexplode(F.array(*map(F.lit, sizes)))).select(
        "source", F.monotonically_increasing_id().alias("doc_id"), F.repeat(F.lit("w "), F.col("col")).alias("text"), F.lit(7).alias("_size"))
    for weigh, by in ((lambda n: n.bit_length(), mixing.binary_digits), (lambda n: 200 // n, lambda n: F.lit(200) / n)):
        got = mixing.mix(df, weights=(1,), weight=by).groupBy("size").agg(F.avg("copies").alias("c")).collect()
        want = dict(zip(sizes, brute_expected(sizes, float(sum(sizes)), weigh)))
        assert len({round(e, 3) for e in want.values()}) > 5 and all(abs(r["c"] - want[r["size"]]) < 0.12 for r in got), (got, want)


def test_mixing_draws_follow_the_chances(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "concat('w ', id) AS text", "if(id < 1000, 'a', if(id < 3000, 'b', 'c')) AS source")
    got = mixing.mix(df, carry={"source": F.col("source")}).groupBy("source").agg(
        F.sum("copies").alias("c"), F.count(F.lit(1)).alias("n"), F.first("target").alias("t")).collect()
    for r in got:
        assert abs(2 * r["c"] - r["t"]) <= 2


def test_stored_tables_can_be_dropped(spark):
    from touchline.llm.common import drop_stored, stored
    kept = stored(spark.range(3).toDF("id"), "numbers")
    assert kept.count() == 3
    drop_stored(spark)
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0]).count()
