"""Token counts of a sentencepiece BPE model by a two-tier lookup in the map stage.

No piece of the model holds a word mark after another character, and none holds a
line feed, so merges never cross from a character to a following word mark, nor
over a line feed: a text's token count is the sum over its pre-tokens, each a run
of word marks and the characters up to the next one. (:func:`check_model` tests
this for the model in hand.)

The first tier is a compact table of frequent pre-tokens and their token counts,
broadcast to all executors. The frequencies are those of all whole texts: each task adds
up its pre-tokens, only these partial counts are shuffled, and a cut by frequency keeps
the rows that meet in the last task to about the table's. A pre-token that isn't in the
table is encoded by the second tier, a bounded cache in each Python worker. Both give
the model's own counts, and every whole text is counted.

Defined results: a null text counts as empty (no tokens); special strings in a text
are ordinary text, as the library's default has it; an empty table gives an empty
result; the input's columns travel in a struct.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, row_struct, stored, text_of

MARK = "▁"
TABLE_SIZE = 1 << 15         # frequent pre-tokens in the broadcast table
CACHE_SIZE = 1 << 18         # pre-tokens in a worker's cache, and in its partial counts
MAX_KEY_CHARS = 64           # longer pre-tokens are encoded, but not kept
_PRE_TOKEN = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


@lru_cache(maxsize=2)
def processor(model: bytes):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def check_model(model: bytes) -> None:
    """Raise unless pre-tokens can be counted apart, and the text isn't normalised."""
    sp = processor(model)
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not sp.is_control(i) and not sp.is_unknown(i)]
    if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
        raise ValueError("a piece crosses a pre-token")
    if sp.encode("ab c\n", out_type=str) != sp.encode(f"ab{MARK}c\n", out_type=str) or sp.decode(sp.encode("a   ﬁ ")) != "a   ﬁ ":
        raise ValueError("the model normalises its input")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text but for line feeds, which are a token each."""
    return _PRE_TOKEN.findall(MARK + text.replace(" ", MARK)) if text else []


class Lengths(dict):
    """Token counts by pre-token: a frequent one from the broadcast table, any other by encoding it once per worker."""

    def __init__(self, sp, table: dict[str, int], cache_size: int):
        super().__init__(table)
        self.sp, self.room = sp, cache_size

    def __missing__(self, word: str) -> int:
        if word == MARK:
            n = 1
        elif word[0] == MARK:
            n = len(self.sp.encode(word[1:]))            # the library puts the first mark before it
        else:
            n = len(self.sp.encode("\n" + word)) - 2     # without a mark: less the mark's and the line feed's own tokens
        if self.room > 0 and len(word) <= MAX_KEY_CHARS:
            self.room -= 1
            self[word] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, pre_tokens(text))) + text.count("\n")


def _frequent(docs: DataFrame, text: Column, model, table_size: int, held: int) -> list:
    """The most frequent pre-tokens of all whole texts with their token counts: at most ``table_size`` rows.
    A task hands its partial counts on once they are more than ``held``."""
    def partial(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["w", "times"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(w for w in pre_tokens(t) if len(w) <= MAX_KEY_CHARS)
                if len(seen) > held:
                    yield partial(seen)
                    seen = Counter()
        yield partial(seen)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(processor(model.value), {}, 0)
        for batch in batches:
            words = batch.column(0)
            yield pa.RecordBatch.from_arrays([words, pa.array([lengths[w] for w in words.to_pylist()], pa.int32())], names=["w", "n"])

    counts = stored(map_arrow(docs.select(text.alias("text")), tally, "w string, times long").groupBy("w").agg(F.sum("times").alias("times")), "pre_tokens")
    words = least = 0
    for r in counts.groupBy("times").agg(F.count("*").alias("words")).orderBy(F.desc("times")).limit(table_size).collect():
        words, least = words + r["words"], r["times"]
        if words >= table_size:
            break
    top = counts.filter(F.col("times") >= least).orderBy(F.desc("times"), "w").limit(table_size)
    return map_arrow(top.select("w"), encode, "w string, n int").collect()


def count_tokens(docs: DataFrame, model_file: str, text_col: str = "text", carry: dict[str, Column] | None = None,
                 table_size: int = TABLE_SIZE, cache_size: int = CACHE_SIZE) -> DataFrame:
    """One row per input row: ``row`` (or the ``carry`` columns), ``n_bytes`` and ``n_tokens``."""
    sc = docs.sparkSession.sparkContext
    with open(model_file, "rb") as f:
        data = f.read()
    check_model(data)
    model = sc.broadcast(data)
    table = sc.broadcast(dict(map(tuple, _frequent(docs, text_of(text_col), model, table_size, cache_size))))
    kept = [row_struct(docs).alias("row")] if carry is None else [c.alias(k) for k, c in carry.items()]
    packed = docs.select(*kept, F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), text_of(text_col).alias("_text"))
    fields = packed.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(processor(model.value), table.value, cache_size)
        for batch in batches:
            counts = pa.array(map(lengths.count, batch.column(len(fields)).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts], names=[*(f.name for f in fields), "n_tokens"])
    return map_arrow(packed, run, T.StructType([*fields, T.StructField("n_tokens", T.LongType())]))
