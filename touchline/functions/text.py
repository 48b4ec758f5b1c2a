"""Text helpers: JS-style number printing, domain extraction (C6), brand
alias patterns (B2/B3)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_number(c: Column, scale: int = 2) -> Column:
    """Print a money value the way JS prints a number: no trailing zeros and
    no trailing dot (``800`` not ``800.0``, ``812.5`` not ``812.50``)."""
    s = c.cast(f"decimal(38,{scale})").cast("string")
    return F.regexp_replace(s, r"\.?0+$", "") if scale > 0 else s


# Fixed value: the characters that trimming strips (ECMAScript white space and line ends).
TRIMMED = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def js_trim(c: Column) -> Column:
    """``String.prototype.trim``: strip leading and trailing white space, the non-ASCII kinds included."""
    return F.regexp_replace(c, rf"^{TRIMMED}+|{TRIMMED}+\z", "")


# URL pattern, trailing punctuation and host rule of C6.
URL_PATTERN = r"""(?i)https?://[^\s"'<>()\[\]{}]+"""
TRAILING_PUNCT = r"[.,;:!?]+$"
HOST_PATTERN = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^@/?#]*@)?([^:/?#]*)"


def to_domain(url: Column) -> Column:
    """Host of a URL (or of ``https://`` + a bare domain), lower-cased,
    without ``www.``; NULL unless it contains a dot."""
    def host(u: Column) -> Column:
        h = F.regexp_replace(F.lower(F.regexp_extract(u, HOST_PATTERN, 1)), r"^www\.", "")
        return F.when(h.contains("."), h)
    direct = F.when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"), host(url))
    return F.coalesce(direct, host(F.concat(F.lit("https://"), url)))


def extract_domains(text: Column) -> Column:
    """Distinct cited domains of the URLs in ``text``, first-seen order."""
    urls = F.regexp_extract_all(text, F.lit(URL_PATTERN), 0)
    doms = F.transform(urls, lambda u: to_domain(F.regexp_replace(u, TRAILING_PUNCT, "")))
    return F.array_distinct(F.filter(doms, lambda d: d.isNotNull()))


def alias_pattern(alias: str) -> str:
    """Separator-flexible, alnum-bounded, case-insensitive pattern for a brand
    alias (Java regex; look-around for the boundaries)."""
    parts = [re.escape(p) for p in re.split(r"[\s.\-_]+", alias.lower()) if p]
    return r"(?i)(?<![a-z0-9])" + r"[\s.\-_]?".join(parts) + r"(?![a-z0-9])"


def alias_pattern_groups(alias: str) -> str:
    """The same rule with the boundaries as groups, for engines without
    look-behind (RE2); apply to the lower-cased text."""
    parts = [re.escape(p) for p in re.split(r"[\s.\-_]+", alias.lower()) if p]
    return r"(^|[^a-z0-9])(" + r"[\s.\-_]?".join(parts) + r")([^a-z0-9]|$)"
