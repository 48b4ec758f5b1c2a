"""Main text of web pages by two-pass block rules.

The markup is read once into blocks: runs of text between block-level tags, each
with its length, its share of linked characters and its share of stop words, and
with what the markup says about its place: inside an element that holds something
other than the article (menu, header, footer, sidebar, notice, advert, form,
comments), or inside one that holds the article.

First pass: a block is bad by such a place or by many links; good if it is long
or has enough stop words for its place; else undecided. Second pass: undecided
short blocks take the label of the nearest decided neighbours on both sides within
the same element of the article, and that element's own where they disagree or
there is none; outside of such elements both sides must be good, for a heading the
next. Where the page marks its article, text outside of it is bad.

Character references are decoded, white space inside a block becomes one space,
and the good blocks are joined in page order by two line feeds.

Defined results: a null or empty page, or one without main text, gives the empty
text; markup cut short is read as far as it goes; equal rows get equal texts; an
empty table gives an empty result; the input's columns travel in a struct.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from .common import map_arrow, row_struct, text_of
from .quality_rules import STOP_WORDS


class Limits(NamedTuple):
    """Thresholds of the first pass."""
    link_share: float = 0.35         # of a block's characters; above it is bad
    short: int = 80                  # characters up to which a block may be undecided
    long: int = 200                  # characters from which stop words decide outside a marked article
    stop_share: float = 0.10         # of a block's words; prose of the listed languages has 0.2 and more


# Fixed values of the markup language: tags that end a run of text, that hold no text
# to read, that have no end, and whose content is never the article.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option
p pre search section summary table tbody td tfoot th thead title tr ul""".split())
UNREAD = ("script", "style", "noscript", "template", "iframe", "textarea", "svg", "math", "object", "canvas", "audio", "video", "title")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_ARTICLE = frozenset("nav header footer aside form menu dialog button select label fieldset search head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
CLOSES = {"li": {"li"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# Words of a class or id that name something other than the article, and the article.
NAMES = frozenset("""ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs byline
comment comments consent cookie cookies copyright disclaimer disqus discussion footer gdpr header login masthead menu
modal nav navbar navigation newsletter notice notices overlay pager pagination popup privacy promo promoted promotion
recommended related replies reply respond responses share sharing sidebar signup skip social sponsor sponsored subscribe
subscription tags teaser toolbar topbar widget widgets""".split())
# Such words that are also found inside others ("cookiebar", "adsbygoogle"), and words that turn them round ("has-sidebar").
STEMS = ("adsby", "advert", "breadcrumb", "cookie", "disqus", "newsletter", "pagination", "sidebar", "sponsor", "subscri")
TURNED = frozenset(("has", "no", "with"))
ARTICLE_NAMES = frozenset("article articlebody entry maincontent maintext post postbody story storybody".split())
WHOLE_NAMES = frozenset(("content", "main", "main-content", "article-body", "article-content", "post-body", "post-content",
                         "entry-content", "story-body", "page-content", "body-content"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(UNREAD) + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)",
    re.S | re.I)
_ATTR = re.compile(r"([a-z][\w:-]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_STOPS = frozenset(STOP_WORDS)
BAD, UNDECIDED, GOOD = -1, 0, 1


class Block(NamedTuple):
    text: str
    linked: int          # characters inside links
    bad_place: bool
    scope: int           # number of the article element it lies in; 0: none
    heading: bool = False


class _Open(NamedTuple):
    tag: str
    bad: bool
    scope: int


def _place(tag: str, attrs: str, inside: _Open) -> tuple[bool, bool]:
    """Whether an element holds something other than the article, and whether it holds the article."""
    bad = tag in NOT_ARTICLE and not (tag == "header" and inside.scope)
    good = tag in ("article", "main")
    if attrs.strip(" /"):
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                names = {w.lower() for w in _NAME.findall(value)}
                in_article = {"header", "byline", "tags"} if inside.scope else set()
                other = not names.isdisjoint(NAMES - in_article) or any(stem in n for n in names for stem in STEMS)
                if other and names.isdisjoint(TURNED) and tag not in ("html", "body", "main"):
                    bad = True
                elif tag in ("div", "section", "td") and (
                        not names.isdisjoint(ARTICLE_NAMES) or not WHOLE_NAMES.isdisjoint(value.lower().split())):
                    good = True
            elif name == "role":
                bad = bad or value.lower() in ROLES
                good = good or value.lower() in ("article", "main")
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(
                    r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                bad = True
    return bad, good and not bad


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    out: list[Block] = []
    stack = [_Open("", False, 0)]
    parts: list[str] = []
    linked = links = scopes = breaks = 0

    def flush() -> None:
        nonlocal linked, breaks
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append(Block(text, linked, stack[-1].bad, stack[-1].scope, any(x.tag in HEADINGS for x in stack[-3:])))
        parts.clear()
        linked = breaks = 0

    def leave(tag: str) -> None:
        nonlocal links
        while stack.pop().tag != tag:
            pass
        links = sum(x.tag == "a" for x in stack)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            run = page[at:m.start()]
            parts.append(run)
            if breaks and not run.isspace():
                breaks = 0
            if links:
                linked += len(run)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            breaks += 1
            parts.append(" ")
            if breaks == 2:
                flush()
            continue
        block = tag in BLOCK
        if block:
            flush()
        if m["end"]:
            if any(x.tag == tag for x in stack):
                leave(tag)
            continue
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        closes = CLOSES.get(tag, {"p"} if block else ())  # ends that may be left out
        for x in reversed(stack) if closes else ():
            if x.tag in closes:
                leave(x.tag)
                break
            if x.tag in BLOCK:
                break
        bad, good = _place(tag, m["attrs"], stack[-1])
        scope = stack[-1].scope
        if good and not scope and (tag == "main" or not stack[-1].bad):
            scopes += 1
            scope = scopes
        if tag == "a":
            links += 1
        stack.append(_Open(tag, bad or stack[-1].bad and tag != "main", scope))
    parts.append(page[at:])
    flush()
    return out


def _stop_share(text: str) -> float:
    words = [w for w in (_EDGES.sub("", x) for x in text.lower().split()) if w]
    return sum(w in _STOPS for w in words) / len(words) if words else 0.0


def _first_pass(b: Block, marked: bool, limits: Limits) -> int:
    if b.bad_place or marked and not b.scope or b.linked > limits.link_share * len(b.text):
        return BAD
    if b.scope:
        return GOOD if len(b.text) > limits.short or _stop_share(b.text) >= limits.stop_share else UNDECIDED
    enough = _stop_share(b.text) >= limits.stop_share
    if len(b.text) > limits.short:
        return GOOD if enough else BAD if len(b.text) < limits.long else UNDECIDED
    return UNDECIDED


def labels(found: list[Block], limits: Limits = Limits()) -> list[int]:
    """Good or bad for every block, by both passes."""
    marked = any(b.scope and not b.bad_place for b in found)
    first = [_first_pass(b, marked, limits) for b in found]

    def nearest(order) -> list[int]:
        # inside an element of the article only that element's blocks are neighbours, and not its excluded parts
        seen: dict[int, int] = {}
        out = [UNDECIDED] * len(found)
        for k in order:
            scope = found[k].scope
            if first[k] != UNDECIDED and not (scope and found[k].bad_place):
                seen[scope] = first[k]
            out[k] = seen.get(scope, UNDECIDED)
        return out
    before, after = nearest(range(len(found))), nearest(range(len(found) - 1, -1, -1))
    out = []
    for k, b in enumerate(found):
        label = first[k]
        if label == UNDECIDED and b.scope:
            sides = {before[k], after[k]} - {UNDECIDED}
            label = sides.pop() if len(sides) == 1 else GOOD
        elif label == UNDECIDED:                         # beyond the page's ends there is nothing good
            label = after[k] if b.heading else min(before[k], after[k])
            label = GOOD if label == GOOD else BAD
        out.append(label)
    return out


def main_text(page: str, limits: Limits = Limits()) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, label in zip(found, labels(found, limits)) if label == GOOD)


def extract(pages: DataFrame, html_col: str = "html", carry: dict[str, Column] | None = None,
            limits: Limits = Limits()) -> DataFrame:
    """One row per input row: ``row`` (or the ``carry`` columns) and ``text``."""
    kept = [row_struct(pages).alias("row")] if carry is None else [c.alias(k) for k, c in carry.items()]
    packed = pages.select(*kept, text_of(html_col).alias("_html"))
    fields = packed.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p, limits) for p in batch.column(len(fields)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*(f.name for f in fields), "text"])
    return map_arrow(packed, run, T.StructType([*fields, T.StructField("text", T.StringType())]))
