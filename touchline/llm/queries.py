"""The registered corpus queries: each applies one operator, with production
parameters, to its whole table and derives the contract's columns from the
operator's result. ``ORACLES`` holds the DuckDB form where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, cotraining, exact_dedup, hard_negatives, html_text, licences, minhash, mixing, quality_rules, secrets, token_counts, toxicity, whitening
from .common import text_of

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- 1 exact dedup -----------------------------------------------------------

EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


@register("op1_exact_dedup", EXACT_SQL)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = exact_dedup.full_hash(exact_dedup.normalised(text_of("text")))
    out = exact_dedup.exact_groups(docs, carry={"text_sha256": digest})
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


# --- 7 quality rules ---------------------------------------------------------

def _rules_sql() -> str:
    stop = ", ".join("'" + w + "'" for w in quality_rules.STOP_WORDS)
    checks = "\n    ".join(
        f"AND {r.over} >= {r.low!r}::DOUBLE * greatest({r.under}, 1) AND {r.over} <= {r.high!r}::DOUBLE * greatest({r.under}, 1)"
        for r in quality_rules.RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(0, 3) AS o(k) GROUP BY rid),
m AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         len(lines) AS n_lines,
         len(list_filter(w, lambda x: lower(rtrim(x, '{quality_rules.EDGE_PUNCTUATION}')) IN ({stop}))) AS n_stop_words,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines
  FROM s LEFT JOIN covered USING (rid)),
f AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
    {checks} AS kept
FROM f
"""


@register("op7_quality_rules", _rules_sql())
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.apply_rules(docs).select(
        F.col("row.doc_id").alias("doc_id"), *quality_rules.BASE, "base_failed", "kept")


# --- 2 MinHash near-dedup ----------------------------------------------------

NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sh AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS r FROM d UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.a WHERE reach.r < e.b),
least AS (SELECT a, min(r) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN least ON least.a = d.doc_id
"""


@register("op2_minhash_near_dedup", NEAR_SQL)
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


# --- 5 mixing ----------------------------------------------------------------

MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
         (('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
f AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing
      FROM w WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
g AS (SELECT *, 3 * source_size * sharing <= weight * rest AS is_full FROM f),
lv AS (SELECT rest, sharing FROM g WHERE NOT is_full ORDER BY 3 * source_size / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN is_full THEN 3.0::DOUBLE * source_size
             ELSE (weight * (SELECT rest FROM lv))::DOUBLE / (SELECT sharing FROM lv)::DOUBLE END AS target FROM g),
n AS (SELECT source, len(bin(size)) AS weight, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
h AS (SELECT a.source, a.weight, a.words, t.source_size, t.target, sum(b.words) FILTER (WHERE b.weight >= a.weight) AS above,
             coalesce(sum(b.weight * b.words) FILTER (WHERE b.weight < a.weight), 0) AS below
      FROM n a JOIN n b ON a.source IS NOT DISTINCT FROM b.source JOIN t ON a.source IS NOT DISTINCT FROM t.source GROUP BY ALL),
q AS (SELECT *, source_size > 0 AND (3 * (above * weight + below))::DOUBLE <= target * weight AS capped FROM h),
x AS (SELECT source, any_value(source_size) AS source_size, any_value(target) AS target,
             (any_value(target) - (3 * coalesce(sum(words) FILTER (WHERE capped), 0))::DOUBLE)
               / nullif(coalesce(sum(weight * words) FILTER (WHERE NOT capped), 0), 0)::DOUBLE AS factor FROM q GROUP BY source),
y AS (SELECT q.source, q.weight, q.words, x.source_size, x.target, CASE WHEN capped THEN 3.0::DOUBLE ELSE coalesce(factor, 0) * q.weight END AS expected
      FROM q JOIN x ON q.source IS NOT DISTINCT FROM x.source),
p AS (SELECT *, floor(expected) AS whole, expected - floor(expected) AS chance,
             target - (sum(words * floor(expected)) OVER (PARTITION BY source))::DOUBLE AS need FROM y),
r AS (SELECT d.doc_id, d.size, p.*, u * (1 - chance) / ((1 - u) * nullif(chance, 0)) AS odds
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND p.weight = len(bin(d.size))),
k AS (SELECT *, odds / (1 + odds) AS rank FROM r),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank) AS cum, sum(size) OVER (PARTITION BY source, rank) AS tied FROM k)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN chance > 0 AND (cum <= need OR cum - need < need - (cum - tied)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""


@register("op5_mix_sources", MIX_SQL)
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), carry={"doc_id": F.col("doc_id")})
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


# --- 3 byte-level BPE --------------------------------------------------------

BPE_FILE = "byte_bpe_multi_50k.tiktoken"


@register("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents")
    return bpe.encode(docs, ranks, pattern, carry={"doc_id": F.col("doc_id")}, decoded=True).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


# --- 4 secret scan -----------------------------------------------------------

@register("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), carry={"doc_id": F.col("doc_id")})
    kinds = [r.kind for r in secrets.BASE_RULES]
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*kinds))
    return found.select("doc_id", *map(count, kinds), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


# --- 6 HTML extraction -------------------------------------------------------

@register("op6_html_text")
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages"), carry={"page_id": F.col("page_id"), "url": F.col("url")})
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


# --- 8 toxicity --------------------------------------------------------------

@register("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.tag(docs, toxicity.fit(docs, labels), carry={"doc_id": F.col("doc_id")})
    return out.select("doc_id", (toxicity.fold("doc_id") == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


# --- 9 quality classifier ----------------------------------------------------

@register("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return cotraining.classify(docs, labels, carry={"doc_id": F.col("doc_id")})


# --- 10 token counts ---------------------------------------------------------

MODEL_FILE = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


@register("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL_FILE),
                                    carry={"doc_id": F.col("doc_id")})
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


# --- 11 embedding whitening --------------------------------------------------

@register("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), carry={"vec_id": F.col("vec_id")})


# --- 12 licence scans --------------------------------------------------------

def _licence_sql() -> str:
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"({listed(licences.ascii_words(p))}, '{label}')" for p, label in licences.BASE_PHRASES.items())
    notices = ",\n  ".join(f"({t}, '{label}', {listed(licences.ascii_words(notice))}, "
                           f"[{', '.join(listed(licences.ascii_words(p)) for p in keys)}])"
                           for t, (label, notice, keys) in enumerate(licences.TEMPLATES))
    return rf"""
WITH base(p, label) AS (VALUES {phrases}),
tpl(t, label, words, phrases) AS (VALUES
  {notices}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents),
word AS (SELECT rid, i, w[i] AS x FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
place AS (SELECT rid, i - 1 AS pos, label FROM word JOIN base ON x = p[1] JOIN d USING (rid) WHERE w[i:i + len(p) - 1] = p),
basic AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS ls FROM place GROUP BY rid),
tw AS (SELECT t, q, words[q] AS x FROM (SELECT t, words, unnest(range(1, len(words) + 1)) AS q FROM tpl)),
freq AS (SELECT x, count(DISTINCT rid) AS df FROM word WHERE x IN (SELECT x FROM tw) GROUP BY x),
rare AS (SELECT t, x FROM (SELECT DISTINCT t, x FROM tw) LEFT JOIN freq USING (x)
         QUALIFY row_number() OVER (PARTITION BY t ORDER BY coalesce(df, 0), x) <= {licences.ANCHORS}),
post AS (SELECT t, q, x FROM tw JOIN rare USING (t, x)),
tp AS (SELECT t, unnest(phrases) AS p FROM tpl),
tq AS (SELECT t, p, min(q) AS q FROM tp JOIN tpl USING (t), range(1, 400) AS r(q) WHERE words[q:q + len(p) - 1] = p GROUP BY t, p),
cand AS (SELECT rid, w FROM d WHERE EXISTS (SELECT 1 FROM tpl WHERE list_has_all(d.w, flatten(phrases)))),
cw AS (SELECT rid, i, x FROM word SEMI JOIN cand USING (rid)),
hit AS (SELECT rid, t, q, i - q AS off, 1 AS is_word FROM cw JOIN post USING (x)
        UNION ALL SELECT rid, t, q, i - q, 0 FROM cw JOIN tq ON cw.x = p[1] JOIN cand USING (rid) WHERE w[i:i + len(p) - 1] = p),
vote AS (SELECT DISTINCT rid, t, q, is_word, floor(off / {licences.SLACK}.0)::BIGINT + k AS b FROM hit, range(0, 2) AS o(k)),
agreed AS (SELECT rid, t, b, sum(is_word) AS words, count(*) - sum(is_word) AS phrases FROM vote GROUP BY rid, t, b),
judged AS (SELECT rid, tpl.label, agreed.words::DOUBLE / n AS part,
                  agreed.phrases = len(tpl.phrases) AND 100 * agreed.words >= {licences.PERCENT} * n AS found
           FROM agreed JOIN tpl USING (t) JOIN (SELECT t, count(*) AS n FROM post GROUP BY t) USING (t)),
more AS (SELECT rid, coalesce(list(DISTINCT label) FILTER (WHERE found), []) AS ls, max(CASE WHEN found THEN part ELSE part / 2 END) AS part
         FROM judged GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       array_to_string(coalesce(basic.ls, []), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(basic.ls, []), coalesce(more.ls, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(part, 0.0) END AS score
FROM d LEFT JOIN basic USING (rid) LEFT JOIN more USING (rid)
"""


@register("op12_licence_scan", _licence_sql())
def op12_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licences.scan(table(spark, sf_dir, "documents"), carry={"doc_id": F.col("doc_id")})
    return out.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


# --- 13 hard-negative mining -------------------------------------------------

NEGATIVES_SQL = r"""
WITH r AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.uid AS anchor, a.vec_id AS anchor_id, r.uid, r.vec_id, r.label = a.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score
      FROM r AS a JOIN r ON a.uid <> r.uid WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor, anchor_id, uid, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor, p.uid ORDER BY score DESC, s.vec_id NULLS LAST)
QUALIFY row_number() OVER w <= 3
"""


@register("op13_hard_negatives", NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), relabel_every=7)


# --- the pipeline ------------------------------------------------------------

@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
