"""Secret scan by one combined deterministic automaton.

Every rule is a regex that ends in a repeated class, so a match ends at the first
byte outside the class. A rule is compiled by subset construction into a search
automaton for leftmost, non-overlapping matches: a set is ordered by where its
threads started, and once a thread has matched, the later ones are dropped and no
new one starts until it dies. The rules' automata are combined into one product,
minimised by partition refinement, and stored as transition arrays over byte
classes; a state's label holds a bit for each rule that is inside a match long
enough to report. One pass over the bytes scans all rules.

The pass is vectorised: an Arrow batch's texts form one buffer, cut into lanes at
bytes after which every state is the start state (a line end, for example), and
all lanes step together. A match's start is found by running the reversed rule's
automaton backwards from its end. Nothing depends on the text's length but the
number of lanes; a text without such bytes is one long lane.

Defined results: a null text counts as empty; equal rows get equal spans; an
empty table gives an empty result; the input's columns travel in a struct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from .common import map_arrow, row_struct, text_of

LANE_BYTES = 1 << 11


class Rule(NamedTuple):
    """``prefix`` and then one or more of ``tail``; reported from ``min_tail`` tail bytes on.
    A match is kept when ``check``, a regex of the whole match, matches it."""
    kind: str
    prefix: str
    tail: str
    min_tail: int
    check: str


# Fixed patterns of the base kinds, then the scan's own additions.
BASE_RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?""",
         r"[A-Za-z0-9+/_.=-]", 1,
         r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}"""),
    Rule("access", r"AKIA", r"[A-Z0-9]", 1, r"[A-Z0-9]{18,}"),
    Rule("hex", r"", r"[0-9a-f]", 16, r"[0-9a-f]{16,}"),
)
EXTRA_RULES = (
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9-]", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY----", r"[-]", 1, r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE_RULES + EXTRA_RULES

# --- regex to position automaton ---------------------------------------------


class _Nfa:
    """Byte-set positions with ordered empty moves; built from the small regex language of the
    rules: literals, ``\\xHH``, classes, groups, ``|``, ``?``, ``*``, ``+``."""

    def __init__(self) -> None:
        self.moves: list[list[int]] = []                 # empty moves of a state, preferred first
        self.step: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.moves.append([])
        self.step.append(None)
        return len(self.moves) - 1


def _parse(src: str):
    """The regex as nested tuples: ('set', bytes), ('cat', …), ('alt', …), ('?'|'*'|'+', x)."""
    at = 0

    def one(escaped_in_class: bool = False) -> int:
        nonlocal at
        c = src[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = src[at]
        at += 1
        if c == "x":
            at += 2
            return int(src[at - 2:at], 16)
        return ord(c)

    def alternatives():
        nonlocal at
        options = [sequence()]
        while at < len(src) and src[at] == "|":
            at += 1
            options.append(sequence())
        return options[0] if len(options) == 1 else ("alt", *options)

    def sequence():
        nonlocal at
        items = []
        while at < len(src) and src[at] not in "|)":
            if src[at] == "(":
                at += 1
                item = alternatives()
                at += 1
            elif src[at] == "[":
                at += 1
                members: set[int] = set()
                while src[at] != "]":
                    low = one()
                    if src[at] == "-" and src[at + 1] != "]":
                        at += 1
                        members.update(range(low, one() + 1))
                    else:
                        members.add(low)
                at += 1
                item = ("set", frozenset(members))
            else:
                item = ("set", frozenset([one()]))
            while at < len(src) and src[at] in "?*+":
                item = (src[at], item)
                at += 1
            items.append(item)
        return ("cat", *items)
    return alternatives()


def _reversed(node):
    if node[0] == "set":
        return node
    parts = [_reversed(x) for x in node[1:]]
    return (node[0], *(parts[::-1] if node[0] == "cat" else parts))


def _build(nfa: _Nfa, node, to: int) -> int:
    """The entry state of ``node`` that leads on to ``to``."""
    kind = node[0]
    if kind == "set":
        s = nfa.state()
        nfa.step[s] = (node[1], to)
        return s
    if kind == "cat":
        for x in node[:0:-1]:
            to = _build(nfa, x, to)
        return to
    s = nfa.state()
    if kind == "alt":
        nfa.moves[s] = [_build(nfa, x, to) for x in node[1:]]
    elif kind == "?":
        nfa.moves[s] = [_build(nfa, node[1], to), to]
    else:
        inner = _build(nfa, node[1], s)
        nfa.moves[s] = [inner, to]
        return s if kind == "*" else inner
    return s


class _Search:
    """Subset construction of one rule's search for leftmost, non-overlapping matches.
    A state is a pair: its threads' positions in order of preference, and whether a match is under way."""

    def __init__(self, rule: Rule):
        self.nfa, self.rule = _Nfa(), rule
        tail = _parse(rule.tail)
        last = self.nfa.state()                          # the repeated tail, long enough
        loop = _build(self.nfa, tail, last)
        self.nfa.moves[last] = [loop]
        self.long, self.matched, to = last, {last}, last
        for _ in range(rule.min_tail - 1):
            entry = _build(self.nfa, tail, to)
            to = self.nfa.state()                        # matched, but not yet long enough
            self.nfa.moves[to] = [entry]
            self.matched.add(to)
        self.entry = _build(self.nfa, ("cat", _parse(rule.prefix), tail), to)
        self.start = self._close([self.entry], False)

    def _close(self, seeds: list[int], under_way: bool):
        order, seen, matched = [], set(), under_way
        for seed in seeds:
            stack = [seed]
            while stack:
                s = stack.pop()
                if s in seen:
                    continue
                seen.add(s)
                order.append(s)
                stack.extend(reversed(self.nfa.moves[s]))
            if any(s in self.matched for s in order):
                matched = True                           # later threads are dropped
                break
        return tuple(order), matched

    def next(self, state, byte: int):
        order, matched = state
        seeds = [self.nfa.step[s][1] for s in order if self.nfa.step[s] and byte in self.nfa.step[s][0]]
        if matched:
            return self._close(seeds, True) if seeds else self.next(self.start, byte)
        return self._close([*seeds, self.entry], False)

    def reports(self, state) -> bool:
        return state[1] and self.long in state[0]


# --- the combined automaton --------------------------------------------------


class Automaton(NamedTuple):
    table: np.ndarray        # next state by state * classes + byte class
    classes: np.ndarray      # byte class by byte
    labels: np.ndarray       # bit set of reporting rules by state
    resets: np.ndarray       # by byte: whether it leads every state to the start state
    n_classes: int


def _byte_classes(searches: list[_Search]) -> np.ndarray:
    sets = list({s[0] for m in searches for s in m.nfa.step if s})
    keys = [tuple(b in s for s in sets) for b in range(256)]
    number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    return np.array([number[k] for k in keys], np.intp)


def _minimised(table: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partition refinement: states stay together while their labels and next blocks agree; state 0 stays 0."""
    block = np.unique(labels, return_inverse=True)[1]
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        if finer.max() == block.max():
            break
        block = finer
    first = np.unique(block, return_index=True)[1]
    order = np.argsort(first)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    keep = first[order]
    return rank[block[table[keep]]], labels[keep]


@lru_cache(maxsize=2)
def compiled(rules: tuple[Rule, ...]) -> Automaton:
    searches = [_Search(r) for r in rules]
    classes = _byte_classes(searches)
    n = int(classes.max()) + 1
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(n)]
    moves: list[dict] = [{} for _ in searches]
    start = tuple(m.start for m in searches)
    number, todo, rows = {start: 0}, [start], []
    for state in todo:
        row = []
        for b in sample:
            parts = []
            for m, known, s in zip(searches, moves, state):
                if (s, b) not in known:
                    known[s, b] = m.next(s, b)
                parts.append(known[s, b])
            to = tuple(parts)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
    labels = np.array([sum(m.reports(s) << k for k, (m, s) in enumerate(zip(searches, state))) for state in todo])
    table, labels = _minimised(np.array(rows, np.intp), labels)
    resets = (table == table[0]).all(axis=0) & (table[0] == 0)
    return Automaton(table.ravel(), classes, labels.astype(np.uint8), resets[classes], n)


@lru_cache(maxsize=2)
def _backward(rules: tuple[Rule, ...]) -> list[tuple[dict, set, frozenset]]:
    """Each rule's reversed automaton, by subset construction: moves, accepting states, start."""
    out = []
    for rule in rules:
        nfa = _Nfa()
        end = nfa.state()
        tree = ("cat", _parse(rule.prefix), ("+", _parse(rule.tail)))
        entry = _build(nfa, _reversed(tree), end)

        def close(seeds):
            seen, stack = set(), list(seeds)
            while stack:
                s = stack.pop()
                if s not in seen:
                    seen.add(s)
                    stack.extend(nfa.moves[s])
            return frozenset(seen)
        start = close([entry])
        moves, todo, seen = {}, [start], {start}
        while todo:
            s = todo.pop()
            for b in range(256):
                to = close([nfa.step[x][1] for x in s if nfa.step[x] and b in nfa.step[x][0]])
                if to:
                    moves[s, b] = to
                    if to not in seen:
                        seen.add(to)
                        todo.append(to)
        out.append((moves, {s for s in seen if end in s}, start))
    return out


def _start_of(back, data: bytes, low: int, end: int) -> int:
    """The leftmost start, not before ``low``, of a match that ends at ``end``."""
    moves, accepting, state = back
    at, found = end, end
    while at > low:
        state = moves.get((state, data[at - 1]))
        if state is None:
            break
        at -= 1
        if state in accepting:
            found = at
    return found


def _reported(auto: Automaton, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which some rule reports, in order, with the labels. ``data`` ends in a reset byte."""
    cuts = np.flatnonzero(auto.resets[data]) + 1
    want = np.arange(LANE_BYTES, len(data), LANE_BYTES)
    starts = np.unique(np.concatenate([[0], cuts[np.searchsorted(cuts, want)]]))
    starts = starts[starts < len(data)]
    sizes = np.diff(np.append(starts, len(data)))
    order = np.argsort(-sizes, kind="stable")
    at, sizes = starts[order], sizes[order]
    running = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")    # lanes longer than the step
    state, codes = np.zeros(len(at), np.intp), auto.classes[data]
    where, what = [], []
    for step, k in enumerate(running):
        s = auto.table[state[:k] * auto.n_classes + codes[at[:k] + step]]
        state[:k] = s
        hit = auto.labels[s]
        if hit.any():
            lanes = np.flatnonzero(hit)
            where.append(at[lanes] + step)
            what.append(hit[lanes])
    if not where:
        return np.empty(0, np.intp), np.empty(0, np.uint8)
    where, what = np.concatenate(where), np.concatenate(what)
    order = np.argsort(where, kind="stable")
    return where[order], what[order]


def scan(texts: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """Each text's spans ``(start, rule number, end)`` in bytes, in order."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    joined = b"\n".join(texts) + b"\n"
    auto, backward = compiled(rules), _backward(rules)
    where, what = _reported(auto, np.frombuffer(joined, np.uint8))
    if not len(where):
        return out
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    checks = [re.compile(r.check.encode(), re.ASCII) for r in rules]
    for k in range(len(rules)):
        mine = where[(what >> k & 1).astype(bool)]
        if not len(mine):
            continue
        ends = mine[np.append(np.diff(mine) > 1, True)] + 1
        low, before = 0, -1
        for end, doc in zip(ends.tolist(), (np.searchsorted(begins, ends - 1, "right") - 1).tolist()):
            base = int(begins[doc])
            if doc != before:
                low, before = base, doc
            start = _start_of(backward[k], joined, low, end)
            low = end
            if checks[k].fullmatch(joined, start, end):
                out[doc].append((start - base, k, end - base))
    for spans in out:
        spans.sort()
    return out


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in bytes as spans in code points."""
    if not spans or text.isascii():
        return spans
    chars = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    place = lambda b: int(chars[b - 1]) if b else 0
    return [(place(s), k, place(e)) for s, k, e in spans]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def find_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES,
                 carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: ``row`` (or the ``carry`` columns) and ``spans``, an array of
    ``(kind, start, end)`` in code points, end exclusive, by start and then rule order."""
    kept = [row_struct(docs).alias("row")] if carry is None else [c.alias(k) for k, c in carry.items()]
    packed = docs.select(*kept, text_of(text_col).alias("_text"))
    fields = packed.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(fields)).cast(pa.large_binary()).to_pylist()
            rows = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in in_code_points(t, spans)]
                    for t, spans in zip(texts, scan(texts, rules))]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind)],
                                             names=[*(f.name for f in fields), "spans"])
    return map_arrow(packed, run, T.StructType([*fields, T.StructField("spans", T.ArrayType(SPAN))]))
