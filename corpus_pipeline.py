"""Corpus pipeline: quality rules, exact dedup, near dedup, mixing to weights, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; what it
returns is written as Parquet and read again as the next one's ``docs``. All but
the last return the columns of ``documents``; the last adds the token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import bpe, exact_dedup, minhash, mixing, quality_rules
from touchline.llm.common import stored, unpack

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with ``n_tokens``, ``ids`` (packed little-endian unsigned
    32-bit integers) and ``round_trip``: whether the ids decode to the text's bytes."""
    ranks, pattern = public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN
    out = bpe.encode(docs, ranks, pattern, decoded=True)
    text = F.coalesce(F.col("row.text"), F.lit("")).cast("binary")
    return out.select(*unpack(out, "row", docs.columns), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                      (F.col("decoded") == text).alias("round_trip"))


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix_sources", mixture), ("byte_bpe", encoded)]

# The last stage runs a tokenizer, which SQL cannot express; tests/llm hold the stages
# against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
