"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

The rank file is read on the driver and broadcast as bytes (a vocabulary file of
fixed size), so executors need no copy of it; each Python worker builds the
encoder once. Ids travel as packed little-endian unsigned 32-bit integers, the
layout training jobs read, and decode to raw bytes, never through text.

A long text is cut before it is encoded, at places where no match of the
split pattern can reach across: between a character that isn't white space and
white space after it. Every match there ends at the cut (only leading spaces
join a match), and what follows doesn't look back, so the pieces' ids
concatenate to the whole text's. A run without such a place stays whole.

Defined results: a null text encodes as the empty text (no ids); null ids decode
to null; equal texts get equal ids; an empty table gives an empty result; the
input's columns travel in a struct.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from .common import map_arrow, row_struct, text_of

PIECE_CHARS = 1 << 16
SLICE_ROWS = 256
_CUT = re.compile(r"\S(?=\s)")


@lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str):
    """The encoder of a rank file's bytes, without special tokens."""
    import tiktoken
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut where no match reaches across."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size - 1)
        if cut is None:
            break
        yield text[at:cut.end()]
        at = cut.end()
    yield text[at:] if at else text


def encode_text(enc, text: str, size: int = PIECE_CHARS) -> np.ndarray:
    if len(text) <= size:
        return np.asarray(enc.encode_ordinary(text), dtype="<u4")
    return np.concatenate([np.asarray(enc.encode_ordinary(p), dtype="<u4") for p in pieces(text, size)])


def decode_ids(enc, ids: bytes) -> bytes:
    return enc.decode_bytes(np.frombuffer(ids, "<u4").tolist())


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch a few rows at a time, so that results never pile up for a whole one."""
    for at in range(0, batch.num_rows, SLICE_ROWS):
        yield batch.slice(at, SLICE_ROWS)


def _read(path: str) -> bytes:
    """A vocabulary file's bytes, from the driver's disk."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text",
           carry: dict[str, Column] | None = None, decoded: bool = False) -> DataFrame:
    """One row per input row: ``row`` (the input row; or the ``carry`` columns, if given)
    and ``ids``, its text's token ids as packed little-endian unsigned 32-bit integers;
    with ``decoded`` also the raw bytes that the ids decode to, in the same pass."""
    kept = [row_struct(docs).alias("row")] if carry is None else [c.alias(k) for k, c in carry.items()]
    packed = docs.select(*kept, text_of(text_col).alias("_text"))
    fields = packed.schema.fields[:-1]
    names = [*(f.name for f in fields), "ids", *["decoded"] * decoded]
    ranks = docs.sparkSession.sparkContext.broadcast(_read(rank_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value, pattern)
        for batch in batches:
            for part in _slices(batch):
                ids = [encode_text(enc, t.as_py()).tobytes() for t in part.column(len(fields))]
                more = [pa.array([decode_ids(enc, x) for x in ids], pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary()), *more], names=names)
    return map_arrow(packed, run, T.StructType([*fields, *[T.StructField(n, T.BinaryType()) for n in names[len(fields):]]]))


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``encoded`` with ``decoded`` added: the raw bytes of its column ``ids``."""
    fields = encoded.schema.fields
    at = encoded.columns.index("ids")
    ranks = encoded.sparkSession.sparkContext.broadcast(_read(rank_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value, pattern)
        for batch in batches:
            for part in _slices(batch):
                values = [None if x is None else decode_ids(enc, x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.binary())], names=[*(f.name for f in fields), "decoded"])
    return map_arrow(encoded, run, T.StructType([*fields, T.StructField("decoded", T.BinaryType())]))
