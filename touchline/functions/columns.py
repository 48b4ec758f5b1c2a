"""Column-expression helpers shared by the operators.

Everything here returns a ``Column`` (or a DataFrame built only from Spark
built-ins), so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import js_trim


def ts_lit(value: str) -> Column:
    """A ``timestamp_ntz`` literal (wall clock, session-zone independent)."""
    return F.lit(value).cast("timestamp_ntz")


def date_lit(value: str) -> Column:
    return F.lit(value).cast("date")


def day_window(col: str | Column, day_from: str, day_to: str) -> Column:
    """Half-open ``[from 00:00, to+1 00:00)`` range on a timestamp column.

    Written as two timestamp comparisons so the predicate reaches the parquet
    scan (a ``to_date(col) BETWEEN`` form would not push down)."""
    c = F.col(col) if isinstance(col, str) else col
    return (c >= F.lit(day_from).cast("date").cast("timestamp_ntz")) & \
        (c < F.date_add(F.lit(day_to).cast("date"), 1).cast("timestamp_ntz"))


def to_double(c: Column) -> Column:
    return c.cast("double")


def pct2(num: Column, den: Column) -> Column:
    """Percent with two decimals, ``Math.round(x*100)/100`` (half up on the
    hundredth), 0 when the base is 0."""
    raw = num.cast("double") / den.cast("double") * 100.0
    return F.when(den > 0, F.floor(raw * 100.0 + 0.5) / 100.0).otherwise(F.lit(0.0))


def money_ratio(num: Column, den: Column, scale: int = 2) -> Column:
    """``round(num/den, scale)`` computed in decimal (half away from zero),
    NULL when the denominator is 0 or NULL; returned as double."""
    n = num.cast("decimal(24,2)")
    d = F.nullif(den.cast("decimal(24,2)"), F.lit(0).cast("decimal(24,2)"))
    return F.round(n / d, scale).cast("double")


def identity_key(user_col: str | Column, linked_col: str | Column, session_col: str | Column) -> Column:
    """``coalesce(user_id, linked user_id, 'sid:' || session_id)`` as text."""
    u = F.col(user_col) if isinstance(user_col, str) else user_col
    lu = F.col(linked_col) if isinstance(linked_col, str) else linked_col
    s = F.col(session_col) if isinstance(session_col, str) else session_col
    return F.coalesce(u.cast("string"), lu.cast("string"), F.concat(F.lit("sid:"), s))


def first_row_flag(df: DataFrame, key: str, ts: str, tie: str, out: str) -> DataFrame:
    """Flag the first row per ``key`` ordered by ``(ts, tie)``.

    Equivalent to ``row_number() over (partition by key order by ts, tie) = 1``
    but skew-safe: the first ``(ts, tie)`` per key is a partial (map-side)
    aggregate, joined back on the key; a hot key only makes the join side
    skewed, which AQE splits. Rows with a NULL key are never first.
    """
    firsts = (df.where(F.col(key).isNotNull())
              .groupBy(key).agg(F.min(F.struct(F.col(ts).alias("t"), F.col(tie).alias("k"))).alias("_first")))
    return (df.join(firsts, key, "left")
            .withColumn(out, F.coalesce(
                (F.col("_first.t") == F.col(ts)) & (F.col("_first.k") == F.col(tie)), F.lit(False)))
            .drop("_first"))


# ---------------------------------------------------------------------------
# Campaign names and channels
# ---------------------------------------------------------------------------

def parse_campaign_name(name: str | Column) -> Column:
    """``{city}_{category}_{objective}`` → struct(city, category, objective, parsed_ok).

    Split on ``_``, trim + lower each part; empty parts become NULL;
    ``parsed_ok`` when there are ≥ 3 parts and the first three are non-empty.
    A NULL or empty name is not parsed."""
    n = F.col(name) if isinstance(name, str) else name
    parts = F.transform(F.split(n, "_"), lambda p: F.lower(js_trim(p)))
    def part(i: int) -> Column:
        return F.nullif(F.get(parts, i), F.lit(""))
    ok = (F.size(parts) >= 3) & part(0).isNotNull() & part(1).isNotNull() & part(2).isNotNull()
    has = n.isNotNull() & (n != "")
    return F.struct(
        F.when(has, part(0)).alias("city"), F.when(has, part(1)).alias("category"),
        F.when(has, part(2)).alias("objective"), F.coalesce(has & ok, F.lit(False)).alias("parsed_ok"))


def _present(c: str) -> Column:
    return F.nullif(F.col(c), F.lit("")).isNotNull()


def infer_channel(prefix: str = "") -> Column:
    """Click-id channel inference: gclid/gbraid/wbraid → google, else
    fbclid/fbc → meta, else NULL. Empty strings count as absent."""
    p = prefix
    return (F.when(_present(p + "gclid") | _present(p + "gbraid") | _present(p + "wbraid"), F.lit("google"))
            .when(_present(p + "fbclid") | _present(p + "fbc"), F.lit("meta")))


# utm_source substrings tested in this order (google list first).
GOOGLE_SOURCE_MARKERS = ["google", "youtube", "gdn", "adwords"]
META_SOURCE_MARKERS = ["facebook", "meta", "instagram", "fb", "ig"]


def infer_channel_from_source(col: str | Column) -> Column:
    c = F.lower(F.col(col) if isinstance(col, str) else col)
    g = None
    for m in GOOGLE_SOURCE_MARKERS:
        g = c.contains(m) if g is None else (g | c.contains(m))
    me = None
    for m in META_SOURCE_MARKERS:
        me = c.contains(m) if me is None else (me | c.contains(m))
    empty = c.isNull() | (c == "")
    return F.when(empty, F.lit(None).cast("string")).when(g, F.lit("google")).when(me, F.lit("meta"))
