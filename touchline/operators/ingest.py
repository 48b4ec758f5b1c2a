"""Sources, validation, normalisation and upserts (S1–S11, V1–V5, C1–C5,
U1–U2, U5–U8).

Validation never raises on data: every rule is a Column that is TRUE when the
row breaks it, and ``validate`` attaches the array of broken rule names —
valid rows have an empty array, the rest go to quarantine with their reasons.
Insert-ignore is ``dropDuplicates`` on the key within the batch plus a
``left_anti`` join against the target; upserts are a join on the key and a
rewrite (no table format with MERGE is available).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import infer_channel, parse_campaign_name
from ..functions.ranking import global_row_number
from ..functions.text import js_trim

# Enums and patterns of the ingest contracts.
APPS = ("services", "society")
ACTION_SOURCES = ("website", "app", "system_generated", "business_messaging")
MESSAGING_CHANNELS = ("whatsapp",)
TOUCH_CHANNELS = ("google", "meta", "ctwa")
TOUCH_TYPES = ("touch", "first_party_click", "lead")
PLATFORMS = ("android", "ios", "web")
REGISTRY_SOURCES = ("app", "click", "lead", "conversion", "touch", "notification", "web")
EXPECTED_FREQUENCIES = ("none", "hourly", "daily", "weekly")
PHONE_HASH_RE = r"^[0-9a-f]{64}$"
EVENT_NAME_RE = r"^[a-z0-9_]+$"
REGISTRY_NAME_RE = r"^[a-z0-9_]{0,64}$"
UUID_RE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
PURCHASE_ACTIONS = ("purchase", "offsite_conversion.fb_pixel_purchase", "omni_purchase")
# beacon gate
BEACON_TOUCH_TYPES = ("touch", "first_party_click")
UTM_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term")
CLICK_ID_KEYS = ("gclid", "fbclid", "gbraid", "wbraid", "fbc", "fbp")
MAX_ID_LEN, MAX_UTM_LEN, MAX_SESSION_LEN = 512, 256, 64
BEACON_MAX_AGE_DAYS, BEACON_MAX_SKEW_MINUTES = 30, 10
# event clamp
EVENT_MAX_AGE_DAYS, EVENT_MAX_SKEW_HOURS = 30, 1


# ---------------------------------------------------------------------------
# validation (V1–V5)
# ---------------------------------------------------------------------------

def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``reasons`` (names of the broken rules, in rule order)."""
    arr = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()])
    return df.withColumn("reasons", F.filter(arr, lambda x: x.isNotNull()))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantine rows with reasons)."""
    return df.where(F.size("reasons") == 0).drop("reasons"), df.where(F.size("reasons") > 0)


def _len_out(c: str, lo: int, hi: int) -> Column:
    return F.col(c).isNotNull() & ((F.length(c) < lo) | (F.length(c) > hi))


def _not_in(c: str, values) -> Column:
    return F.col(c).isNotNull() & ~F.col(c).isin(*values)


def conversion_rules() -> dict[str, Column]:
    """V1 (``action_source`` defaults to ``app`` before checking)."""
    return {
        "app": F.col("app").isNull() | ~F.col("app").isin(*APPS),
        "order_id": F.col("order_id").isNull() | (F.length("order_id") < 1),
        "user_id": F.col("user_id").isNotNull() & (F.col("user_id") <= 0),
        "value_inr": F.col("value_inr").isNull() | (F.col("value_inr") < 0),
        "is_first_order": F.col("is_first_order").isNull(),
        "action_source": _not_in("action_source", ACTION_SOURCES),
        "occurred_at": F.col("occurred_at").isNull(),
        "ctwa_clid": _len_out("ctwa_clid", 1, MAX_ID_LEN),
        "messaging_channel": _not_in("messaging_channel", MESSAGING_CHANNELS),
    }


def validate_conversions(batch: DataFrame) -> DataFrame:
    b = batch.withColumn("action_source", F.coalesce(F.col("action_source"), F.lit("app")))
    return validate(b, conversion_rules())


def validate_touches(batch: DataFrame) -> DataFrame:
    """V2 (``touch_type`` defaults to ``touch``, ``consent`` to false)."""
    b = (batch.withColumn("touch_type", F.coalesce(F.col("touch_type"), F.lit("touch")))
         .withColumn("consent", F.coalesce(F.col("consent"), F.lit(False))))
    return validate(b, {
        "app": F.col("app").isNull() | ~F.col("app").isin(*APPS),
        "session_id": F.col("session_id").isNull() | (F.length("session_id") < 1),
        "user_id": F.col("user_id").isNotNull() & (F.col("user_id") <= 0),
        "channel": _not_in("channel", TOUCH_CHANNELS),
        "touch_type": ~F.col("touch_type").isin(*TOUCH_TYPES),
        "ctwa_clid": _len_out("ctwa_clid", 1, MAX_ID_LEN),
        "wa_phone_hash": F.col("wa_phone_hash").isNotNull() & ~F.col("wa_phone_hash").rlike(PHONE_HASH_RE),
    })


def validate_leads(batch: DataFrame) -> DataFrame:
    """V3."""
    return validate(batch, {
        "app": F.col("app").isNull() | ~F.col("app").isin(*APPS),
        "ctwa_clid": F.col("ctwa_clid").isNull() | _len_out("ctwa_clid", 1, MAX_ID_LEN),
        "wa_phone_hash": F.col("wa_phone_hash").isNotNull() & ~F.col("wa_phone_hash").rlike(PHONE_HASH_RE),
        "lead_ref": _len_out("lead_ref", 0, 64),
    })


def validate_events(batch: DataFrame) -> DataFrame:
    """V4 (the 1–200 batch size is a transport limit, not a row rule)."""
    return validate(batch, {
        "event_id": F.col("event_id").isNull() | ~F.col("event_id").rlike(UUID_RE),
        "event_name": F.col("event_name").isNull() | (F.length("event_name") < 1) | (F.length("event_name") > 64)
        | ~F.col("event_name").rlike(EVENT_NAME_RE),
        "occurred_at": F.col("occurred_at").isNull(),
        "session_id": _len_out("session_id", 0, 64),
        "user_id": F.col("user_id").isNotNull() & (F.col("user_id") <= 0),
        "platform": _not_in("platform", PLATFORMS),
        "app_version": _len_out("app_version", 0, 32),
    })


def validate_registry(batch: DataFrame) -> DataFrame:
    """V5 with defaults ``event_name=''``, ``expected_frequency='none'``,
    ``is_active=true``."""
    b = (batch.withColumn("event_name", F.coalesce(F.col("event_name"), F.lit("")))
         .withColumn("expected_frequency", F.coalesce(F.col("expected_frequency"), F.lit("none")))
         .withColumn("is_active", F.coalesce(F.col("is_active"), F.lit(True))))
    return validate(b, {
        "app": F.col("app").isNull() | ~F.col("app").isin(*APPS),
        "source": F.col("source").isNull() | ~F.col("source").isin(*REGISTRY_SOURCES),
        "event_name": ~F.col("event_name").rlike(REGISTRY_NAME_RE),
        "expected_frequency": ~F.col("expected_frequency").isin(*EXPECTED_FREQUENCIES),
        "description": _len_out("description", 0, 500),
    })


# ---------------------------------------------------------------------------
# scalar enrichments
# ---------------------------------------------------------------------------

def parse_campaign_names(entities: DataFrame) -> DataFrame:
    """Add city / category / objective / parsed_ok from the name."""
    p = parse_campaign_name(F.col("name"))
    return (entities.withColumn("_p", p)
            .withColumn("city", F.col("_p.city")).withColumn("category", F.col("_p.category"))
            .withColumn("objective", F.col("_p.objective")).withColumn("parsed_ok", F.col("_p.parsed_ok"))
            .drop("_p"))


def campaign_name_lint(entities: DataFrame) -> DataFrame:
    """C1 report: entity counts by ``parsed_ok`` per level."""
    return (parse_campaign_names(entities).groupBy("level", "parsed_ok")
            .agg(F.count(F.lit(1)).alias("entities")))


def assert_currency(df: DataFrame, expected: str = "INR", col: str = "currency") -> tuple[DataFrame, DataFrame]:
    """C4: (rows whose currency matches, is NULL or empty, quarantined mismatches)."""
    bad = F.nullif(F.col(col), F.lit("")).isNotNull() & (F.upper(F.col(col)) != expected.upper())
    return df.where(~bad), df.where(bad).withColumn("reasons", F.array(F.lit("currency")))


def rolling_window(now: str, days: int = 8) -> tuple[str, str]:
    """The inclusive day window ending today that absorbs restatements."""
    today = dt.datetime.fromisoformat(now).date()
    return (today - dt.timedelta(days=days - 1)).isoformat(), today.isoformat()


# ---------------------------------------------------------------------------
# report normalisation
# ---------------------------------------------------------------------------

def normalize_social_entities(campaigns: DataFrame, adsets: DataFrame, ads: DataFrame) -> DataFrame:
    """Three entity lists → one canonical frame; parent = campaign id for
    ad sets, ad set id for ads; budgets arrive in minor units (÷100)."""
    def one(df, level, parent):
        par = F.col(parent) if parent else F.lit(None).cast("string")
        budget = (F.col("daily_budget").cast("decimal(20,2)") / 100).cast("decimal(14,2)") \
            if "daily_budget" in df.columns else F.lit(None).cast("decimal(14,2)")
        return df.select(F.lit("meta").alias("channel"), F.lit(level).alias("level"),
                         F.col("id").alias("external_id"), par.alias("parent_external_id"), F.col("name"),
                         F.col("effective_status").alias("status"), budget.alias("current_daily_budget_inr"))
    return (one(campaigns, "campaign", None).unionByName(one(adsets, "adset", "campaign_id"))
            .unionByName(one(ads, "ad", "adset_id")))


def _sum_purchase(arr: Column) -> Column:
    purchases = F.filter(F.coalesce(arr, F.array().cast("array<struct<action_type:string,value:string>>")),
                         lambda a: a["action_type"].isin(*PURCHASE_ACTIONS))
    return F.aggregate(purchases, F.lit(0).cast("decimal(20,2)"),
                       lambda acc, a: (acc + F.coalesce(a["value"].try_cast("decimal(20,2)"),
                                                        F.lit(0).cast("decimal(20,2)"))).cast("decimal(20,2)"))


def normalize_social_performance(insights: DataFrame) -> DataFrame:
    """Ad-day rows; conversions / value = Σ of purchase-type actions;
    rows without ad id or date are dropped; missing numbers are 0."""
    r = insights.where(F.col("ad_id").isNotNull() & (F.col("ad_id") != "")
                       & F.col("date_start").isNotNull() & (F.col("date_start") != ""))
    num = lambda c, t: F.coalesce(F.col(c).try_cast(t), F.lit(0).cast(t))
    return r.select(F.lit("meta").alias("channel"), F.col("ad_id").alias("external_id"),
                    F.col("date_start").cast("date").alias("stat_date"),
                    num("spend", "decimal(14,2)").alias("spend_inr"), num("impressions", "bigint").alias("impressions"),
                    num("clicks", "bigint").alias("clicks"), _sum_purchase(F.col("actions")).alias("conversions"),
                    _sum_purchase(F.col("action_values")).alias("conv_value_inr"))


def extract_search_entities(report: DataFrame) -> DataFrame:
    """S3: distinct campaign and ad-group entities of a report stream, the
    first row (``row_order``) of each entity wins."""
    camp = report.where(F.col("campaign.id").isNotNull()).select(
        F.lit("campaign").alias("level"), F.col("campaign.id").alias("external_id"),
        F.lit(None).cast("string").alias("parent_external_id"), F.col("campaign.name").alias("name"),
        F.col("campaign.status").alias("status"), "row_order")
    grp = report.where(F.col("adGroup.id").isNotNull()).select(
        F.lit("adset").alias("level"), F.col("adGroup.id").alias("external_id"),
        F.col("campaign.id").alias("parent_external_id"), F.col("adGroup.name").alias("name"),
        F.lit(None).cast("string").alias("status"), "row_order")
    both = camp.unionByName(grp)
    first = (both.groupBy("level", "external_id")
             .agg(F.min_by(F.struct("parent_external_id", "name", "status"), F.col("row_order")).alias("f"),
                  F.min("row_order").alias("first_row")))
    return first.select(F.lit("google").alias("channel"), "level", "external_id",
                        F.col("f.parent_external_id").alias("parent_external_id"), F.col("f.name").alias("name"),
                        F.col("f.status").alias("status"), "first_row")


def normalize_search_performance(report: DataFrame) -> DataFrame:
    """Campaign-level rows, spend = micros / 1e6; the report is at
    ad-group grain, so one campaign-day repeats and is summed (trap X13)."""
    there = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull()
    r = report.where(there("campaign.id") & there("segments.date"))
    rows = r.select(F.col("campaign.id").alias("external_id"), F.col("segments.date").cast("date").alias("stat_date"),
                    (F.coalesce(F.col("metrics.costMicros").try_cast("decimal(24,0)"), F.lit(0).cast("decimal(24,0)"))
                     / F.lit(1000000)).alias("spend"),
                    F.coalesce(F.col("metrics.impressions").try_cast("bigint"), F.lit(0)).alias("impressions"),
                    F.coalesce(F.col("metrics.clicks").try_cast("bigint"), F.lit(0)).alias("clicks"),
                    # summed as decimals: a sum of doubles depends on the order of the tasks
                    F.coalesce(F.col("metrics.conversions"), F.lit(0.0)).cast("decimal(28,10)").alias("conversions"),
                    F.coalesce(F.col("metrics.conversionsValue"), F.lit(0.0)).cast("decimal(28,10)").alias("conv_value"))
    return (rows.groupBy("external_id", "stat_date")
            .agg(F.sum("spend").cast("decimal(14,2)").alias("spend_inr"), F.sum("impressions").alias("impressions"),
                 F.sum("clicks").alias("clicks"), F.sum("conversions").cast("double").alias("conversions"),
                 F.sum("conv_value").cast("double").alias("conv_value_inr"))
            .select(F.lit("google").alias("channel"), "*"))


# ---------------------------------------------------------------------------
# inserts (S5–S8, S10, S11)
# ---------------------------------------------------------------------------

def insert_ignore(batch: DataFrame, target: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of ``batch`` whose key is new: one per key (the first by ``order``,
    then by all columns, so runs agree) and absent from ``target``."""
    return one_per_key(batch, key, order).join(target.select(*key), key, "left_anti")


def one_per_key(batch: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """The least row of each key, by ``order`` and then by the other columns."""
    rest = [*(order or []), *[c for c in batch.columns if c not in key and c not in (order or [])]]
    if not rest:
        return batch.distinct()
    first = batch.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r"))
    return first.select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in batch.columns])


def clamp_occurred_at(ts: Column, now: Column) -> Column:
    """S5 clamp to ``[now − 30 d, now + 1 h]``."""
    lo = now - F.make_dt_interval(days=F.lit(EVENT_MAX_AGE_DAYS))
    hi = now + F.make_dt_interval(hours=F.lit(EVENT_MAX_SKEW_HOURS))
    return F.least(F.greatest(ts, lo), hi)


def ingest_events(batch: DataFrame, existing: DataFrame, now: Column | str) -> DataFrame:
    """New event rows — clamped time, first copy per ``event_id`` (the
    dedup key is taken before clamping, SURVEY X12), absent from the target."""
    n = F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now
    b = batch.withColumn("occurred_at", clamp_occurred_at(F.col("occurred_at"), n))
    return insert_ignore(b, existing, ["event_id"], order=["received_at"] if "received_at" in b.columns else None)


def ingest_report(batch: DataFrame, inserted: DataFrame) -> DataFrame:
    """S5 response: received / inserted counts (one row)."""
    return batch.agg(F.count(F.lit(1)).alias("received")).select(
        "received", inserted.agg(F.count(F.lit(1))).scalar().alias("inserted"))


def ingest_touches(batch: DataFrame, received_at: str) -> DataFrame:
    """Canonical touch rows — explicit channel wins over click-id
    inference, ``touch_type`` defaults to ``touch``, ``occurred_at`` to the
    receive time."""
    for c in ("gclid", "gbraid", "wbraid", "fbclid", "fbc"):
        if c not in batch.columns:
            batch = batch.withColumn(c, F.lit(None).cast("string"))
    rt = F.lit(received_at).cast("timestamp_ntz")
    return (batch.withColumn("channel", F.coalesce(F.col("channel"), infer_channel()))
            .withColumn("touch_type", F.coalesce(F.col("touch_type"), F.lit("touch")))
            .withColumn("occurred_at", F.coalesce(F.col("occurred_at"), rt))
            .withColumn("received_at", rt))


def ingest_conversions(batch: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new conversion rows — insert-ignore on ``(app, order_id)`` —,
    batch rows with a ``deduped`` flag). Identity edges come from every batch
    row with a session and a user, duplicate orders included (U3)."""
    new = insert_ignore(batch, existing, ["app", "order_id"], order=["id"] if "id" in batch.columns else None)
    flagged = (batch.join(new.select("app", "order_id", F.col("id").alias("_new_id")), ["app", "order_id"], "left")
               .withColumn("deduped", F.col("_new_id").isNull() | (F.col("_new_id") != F.col("id")))
               .drop("_new_id"))
    return new, flagged


def ingest_leads(batch: DataFrame, existing: DataFrame, now: str) -> DataFrame:
    """New leads — insert-ignore on ``(app, ctwa_clid)``; ``occurred_at``
    defaults to now."""
    b = batch.withColumn("occurred_at", F.coalesce(F.col("occurred_at"), F.lit(now).cast("timestamp_ntz")))
    return insert_ignore(b, existing, ["app", "ctwa_clid"], order=["id"] if "id" in b.columns else None)


def from_epoch_seconds(c: Column) -> Column:
    """Epoch seconds → wall-clock UTC ``timestamp_ntz`` (session-zone free)."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=c.cast("decimal(18,6)"))


def flag_first_orders(bookings: DataFrame) -> DataFrame:
    """Paid bookings only; ``occurred_at`` from epoch seconds; first
    order = the user's first paid booking (by time, then id)."""
    from ..functions.columns import first_row_flag
    paid = (bookings.where(F.col("payment_status") == "paid")
            .withColumn("occurred_at", from_epoch_seconds(F.col("created_at"))))
    return first_row_flag(paid, "user_id", "created_at", "id", "is_first_order")


def _clean(c: Column, max_len: int) -> Column:
    t = js_trim(c)
    return F.when((t != "") & (F.length(t) <= max_len), t)


def sanitize_touches(raw: DataFrame, now: str, app: str = "services") -> DataFrame:
    """The public-touch gate. Adds ``reject_reason`` (NULL for accepted
    rows) and the sanitised columns: trimmed/capped strings, click ids only
    with consent, client time only inside ``[now − 30 d, now + 10 min]``."""
    n = F.lit(now).cast("timestamp_ntz")
    present = [c for c in raw.columns]
    def col(c):
        return F.col(c) if c in present else F.lit(None).cast("string")
    sess = _clean(col("session_id"), MAX_SESSION_LEN)
    tt = F.coalesce(col("touch_type"), F.lit("touch"))
    consent = F.coalesce(col("consent").cast("boolean"), F.lit(False)) if "consent" in present else F.lit(False)
    utms = {k: _clean(col(k), MAX_UTM_LEN) for k in UTM_KEYS}
    clicks = {k: F.when(consent, _clean(col(k), MAX_ID_LEN)) for k in CLICK_ID_KEYS}
    raw_click = F.lit(False)
    for k in CLICK_ID_KEYS:
        raw_click = raw_click | F.coalesce(col(k) != "", F.lit(False))
    signal = F.lit(False)
    for v in list(utms.values()) + list(clicks.values()):
        signal = signal | v.isNotNull()
    signal = signal | (~consent & raw_click)
    reason = (F.when(sess.isNull() | ~sess.rlike(UUID_RE), F.lit("session_id"))
              .when(~tt.isin(*BEACON_TOUCH_TYPES), F.lit("touch_type"))
              .when(~signal, F.lit("no_signal")))
    ts = col("occurred_at")
    ts = ts.cast("timestamp_ntz") if "occurred_at" in present else F.lit(None).cast("timestamp_ntz")
    ok_ts = ts.isNotNull() & (ts >= n - F.make_dt_interval(days=F.lit(BEACON_MAX_AGE_DAYS))) \
        & (ts <= n + F.make_dt_interval(mins=F.lit(BEACON_MAX_SKEW_MINUTES)))
    out = [F.lit(app).alias("app"), sess.alias("session_id"), tt.alias("touch_type"), consent.alias("consent")]
    out += [v.alias(k) for k, v in utms.items()] + [v.alias(k) for k, v in clicks.items()]
    out += [_clean(col("landing_url"), MAX_ID_LEN).alias("landing_url"),
            _clean(col("referrer"), MAX_ID_LEN).alias("referrer"),
            F.when(ok_ts, ts).alias("occurred_at"), reason.alias("reject_reason")]
    keep = [c for c in ("event_id",) if c in present]
    return raw.select(*keep, *out)


# ---------------------------------------------------------------------------
# upserts (U1, U2) and partition retention
# ---------------------------------------------------------------------------

ENTITY_KEY = ["app", "channel", "level", "external_id"]
ENTITY_UPDATABLE = ["name", "city", "category", "objective", "status", "current_daily_budget_inr"]


def upsert_entities(target: DataFrame, batch: DataFrame, now: str, order: list[str] | None = None) -> DataFrame:
    """The entity table after upserting ``batch`` on
    ``(app, channel, level, external_id)``. Existing keys take the batch's
    name (and the parsed city / category / objective), status and budget;
    parent, currency, id and created_at are kept. New keys get ids above the
    current maximum, numbered in key order. Of a key that repeats in the batch
    the first row by ``order``, then by all columns, counts."""
    b = parse_campaign_names(batch).drop("parsed_ok")
    for c in ENTITY_UPDATABLE + ["parent_external_id", "currency"]:
        if c not in b.columns:
            b = b.withColumn(c, F.lit(None).cast(target.schema[c].dataType if c in target.columns else "string"))
    b = one_per_key(b, ENTITY_KEY, order)
    n = F.lit(now).cast("timestamp_ntz")
    j = target.alias("t").join(b.withColumn("_in", F.lit(True)).alias("b"), ENTITY_KEY, "full")
    upd = {c: F.when(F.col("b._in"), F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")) for c in ENTITY_UPDATABLE}
    exists = F.col("t.id").isNotNull()

    def kept(c):   # stored value for existing keys (even NULL), batch value for new keys
        return F.when(exists, F.col(f"t.{c}")).otherwise(F.col(f"b.{c}").cast(target.schema[c].dataType))
    rows = j.select(*ENTITY_KEY, F.col("t.id").alias("id"), kept("parent_external_id").alias("parent_external_id"),
                    *[upd[c].cast(target.schema[c].dataType).alias(c) for c in ENTITY_UPDATABLE],
                    kept("currency").alias("currency"),
                    F.coalesce(F.col("t.created_at"), n).alias("created_at"),
                    F.when(F.col("b._in"), n).otherwise(F.col("t.updated_at")).alias("updated_at"))
    old = rows.where(F.col("id").isNotNull())
    new = rows.where(F.col("id").isNull()).drop("id")
    base = target.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()      # current max id
    numbered = global_row_number(new, [], ENTITY_KEY, out="_rn") \
        .withColumn("id", (base + F.col("_rn")).cast("long")).drop("_rn")
    return old.unionByName(numbered.select(*old.columns))


PERF_MEASURES = ["spend_inr", "impressions", "clicks", "conversions", "conv_value_inr"]


def upsert_performance(target: DataFrame, batch: DataFrame, entities: DataFrame, now: str,
                       order: list[str] | None = None) -> DataFrame:
    """The performance table after replacing the five measures of every
    ``(app, ad_entity_id, stat_date)`` in ``batch``. Batch rows name the
    entity by ``(channel, external_id)`` — level is not part of the lookup
    (lowest id wins) — and rows of unknown entities are skipped. Of a key that
    repeats in the batch the first row by ``order``, then by all columns,
    counts. To rewrite only the days in question, pass the target's rows of
    ``rolling_window`` (C5) and replace their partitions."""
    lookup = (entities.groupBy("app", "channel", "external_id").agg(F.min("id").alias("ad_entity_id")))
    rows = (batch.join(lookup, ["app", "channel", "external_id"])
            .select("app", "ad_entity_id", "stat_date", "channel", *[F.col(m) for m in PERF_MEASURES], *(order or [])))
    rows = (one_per_key(rows, ["app", "ad_entity_id", "stat_date"], order).drop(*(order or []))
            .withColumn("ingested_at", F.lit(now).cast("timestamp_ntz")))
    kept = target.join(rows.select("app", "ad_entity_id", "stat_date"), ["app", "ad_entity_id", "stat_date"],
                       "left_anti")
    cols = kept.columns
    return kept.unionByName(rows.select(*[F.col(c).cast(target.schema[c].dataType) for c in cols]))


def assign_event_month(ts: Column, zone: str = "Asia/Kolkata") -> Column:
    """``yyyy_MM`` of the half-open calendar month in ``zone``."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts), "yyyy_MM")


def retained_months(now: str, months: int = 13) -> list[str]:
    """Month suffixes kept as of ``now``: from ``now − (months − 1)`` to
    ``now + 2`` inclusive (the months pre-created ahead)."""
    d = dt.datetime.fromisoformat(now)
    out = []
    for off in range(-(months - 1), 3):
        z = d.month - 1 + off
        out.append(f"{d.year + z // 12:04d}_{z % 12 + 1:02d}")
    return out


def retain_event_months(events: DataFrame, now: str, months: int = 13, zone: str = "Asia/Kolkata") -> DataFrame:
    """Per month partition of ``events`` — rows and whether it is kept;
    the dropped ones are the partitions a retention job deletes."""
    keep = retained_months(now, months)
    return (events.withColumn("event_month", assign_event_month(F.col("occurred_at"), zone))
            .groupBy("event_month").agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("retained", F.col("event_month").isin(*keep)))


# ---------------------------------------------------------------------------
# small metadata upserts
# ---------------------------------------------------------------------------

def seed_segments(target: DataFrame, specs: DataFrame, events_available: bool, now: str) -> DataFrame:
    """Upsert system segment definitions on ``(app, slug)``: name,
    description, definition and interval are replaced; every other column of
    the target (refresh bookkeeping, status, creation) is kept. New specs get
    ids above the current maximum in key order, and start ``paused`` when they
    need events that are missing."""
    n = F.lit(now).cast("timestamp_ntz")
    for c in ("description",):
        specs = specs if c in specs.columns else specs.withColumn(c, F.lit(None).cast("string"))
        target = target if c in target.columns else target.withColumn(c, F.lit(None).cast("string"))
    j = target.alias("t").join(specs.withColumn("_in", F.lit(True)).alias("s"), ["app", "slug"], "full")
    is_in = F.coalesce(F.col("s._in"), F.lit(False))
    is_new = F.col("t.id").isNull()
    status = F.when(F.col("s.needs_events") & F.lit(not events_available), F.lit("paused")).otherwise(F.lit("active"))
    replaced = ("name", "description", "definition", "refresh_interval_minutes")
    initial = {"status": status, "is_system": F.lit(True), "created_at": n}

    def column(c: str) -> Column:
        if c in ("app", "slug"):
            return F.col(c)
        if c in replaced:
            return F.when(is_in, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
        if c == "updated_at":
            return F.when(is_in, n).otherwise(F.col("t.updated_at")).alias(c)
        return (F.when(is_new, initial[c]).otherwise(F.col(f"t.{c}")) if c in initial else F.col(f"t.{c}")).alias(c)
    rows = j.select(*[column(c) for c in target.columns])
    base = target.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    new = (global_row_number(rows.where(F.col("id").isNull()), [], ["app", "slug"], out="_rn")
           .withColumn("id", (base + F.col("_rn")).cast(target.schema["id"].dataType)).select(*rows.columns))
    return rows.where(F.col("id").isNotNull()).unionByName(new)


REGISTRY_KEY = ["app", "source", "event_name"]


REGISTRY_PATCHED = ["event_name", "description", "expected_frequency", "is_active"]


def upsert_registry(target: DataFrame, changes: DataFrame, now: str, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """U8: apply a change set (``op`` ∈ insert / update / delete) to the
    registry. Of inserts with one key the first (by ``order``, then by all
    columns) is made; later ones, and inserts and renames whose key is taken
    before or after the other changes, go to the conflicts frame. Updates patch the non-NULL ones of event name,
    description, frequency and active flag of ``id`` and stamp it; deletes
    remove ``id``; all other rows and columns stay as they are. Returns
    (registry ordered by source, name; conflicts)."""
    n = F.lit(now).cast("timestamp_ntz")
    for c, kind in (("description", "string"), ("created_at", "timestamp_ntz"), ("updated_at", "timestamp_ntz")):
        if c not in target.columns:
            target = target.withColumn(c, F.lit(None).cast(kind))
    for c in REGISTRY_PATCHED:
        if c not in changes.columns:
            changes = changes.withColumn(c, F.lit(None).cast(target.schema[c].dataType))
    kept = target.join(changes.where(F.col("op") == "delete").select("id").distinct(), "id", "left_anti")
    patch = one_per_key(changes.where(F.col("op") == "update").select("id", *REGISTRY_PATCHED, *(order or [])), ["id"], order)
    patch = patch.select("id", *[F.col(c).alias(f"_{c}") for c in REGISTRY_PATCHED], F.lit(True).alias("_hit"))
    now_ = kept.join(patch, "id", "left")
    for c in REGISTRY_PATCHED:
        now_ = now_.withColumn(f"_{c}", F.coalesce(f"_{c}", c))
    # a rename onto a key that another row has, or gets, is refused as a whole
    key = ["app", "source", F.col("_event_name").alias("event_name")]
    taken = now_.groupBy(*key).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c").withColumn("_taken", F.lit(True))
    now_ = now_.join(taken.withColumnRenamed("event_name", "_event_name"), ["app", "source", "_event_name"], "left")
    renamed = F.coalesce(F.col("_hit"), F.lit(False)) & (F.col("_event_name") != F.col("event_name"))
    refused = renamed & F.coalesce(F.col("_taken"), F.lit(False))
    clash_upd = now_.where(refused).select("app", "source", F.col("_event_name").alias("event_name"))
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & ~refused
    cur = now_.select(*[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in REGISTRY_PATCHED
                        else F.when(hit, n).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in target.columns])
    ins = changes.where(F.col("op") == "insert").withColumn("event_name", F.coalesce("event_name", F.lit("")))
    first = one_per_key(ins.drop("id", "op"), REGISTRY_KEY, order)
    again = ins.groupBy(*REGISTRY_KEY).agg((F.count(F.lit(1)) - 1).cast("int").alias("_n")).where("_n > 0")
    again = again.select(*REGISTRY_KEY, F.explode(F.array_repeat(F.lit(0), F.col("_n")))).select(*REGISTRY_KEY)
    used = cur.select(*REGISTRY_KEY).unionByName(target.select(*REGISTRY_KEY)).distinct()
    taken_ins = first.join(used, REGISTRY_KEY, "left_semi").select(*REGISTRY_KEY)
    good = first.join(used, REGISTRY_KEY, "left_anti")
    base = target.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    given = {"id": (base + F.col("_rn")).cast(target.schema["id"].dataType), "created_at": n, "updated_at": n,
             "expected_frequency": F.coalesce("expected_frequency", F.lit("none")), "is_active": F.coalesce("is_active", F.lit(True))}
    numbered = global_row_number(good, [], REGISTRY_KEY, out="_rn")
    new = numbered.select(*[(given[c] if c in given else F.col(c) if c in numbered.columns
                             else F.lit(None).cast(target.schema[c].dataType)).alias(c) for c in target.columns])
    out = cur.unionByName(new).orderBy("source", "event_name")
    clash = clash_upd.unionByName(taken_ins).unionByName(again)
    return out, clash.select(*REGISTRY_KEY, F.lit("duplicate key").alias("error"))


# ---------------------------------------------------------------------------
# review snapshots
# ---------------------------------------------------------------------------

REVIEW_ZONE = "Asia/Kolkata"


def _js_round2(x: Column) -> Column:
    """``Math.round(x * 100) / 100`` on a double."""
    return F.floor(x.cast("double") * 100.0 + 0.5) / 100.0


def snapshot_reviews(fetches: DataFrame, existing: DataFrame | None = None, zone: str = REVIEW_ZONE,
                     tiebreak: str | None = None) -> DataFrame:
    """One review snapshot per ``(app, source, local day)``.

    ``fetches`` are raw store reads: ``app, source, observed_at`` plus either
    aggregate fields ``avg_rating`` / ``rating_count`` (lookup-style stores) or
    a comment feed ``reviews: array<struct<star:int>>`` (feed-style store).
    Aggregates give the rounded average and the count; a feed gives the mean
    star over entries that carry one and the number of entries returned. The
    first fetch of the local day wins (``tiebreak`` orders fetches with the
    same time); days already in ``existing`` are kept.
    """
    feed = F.col("reviews")
    stars = F.filter(F.transform(feed, lambda r: r["star"]), lambda s: s.isNotNull())
    mean = F.aggregate(stars, F.lit(0).cast("long"), lambda a, s: a + s) / F.size(stars)
    is_feed = feed.isNotNull()
    tb = [F.col(tiebreak).alias("_tb")] if tiebreak else []
    rows = fetches.select(
        "app", "source", "observed_at", *tb,
        F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("observed_at"))).alias("snapshot_date"),
        F.when(is_feed, F.when(F.size(stars) > 0, _js_round2(mean)))
        .otherwise(_js_round2(F.col("avg_rating"))).cast("decimal(3,2)").alias("rating_avg"),
        F.when(is_feed, F.lit(None).cast("int")).otherwise(F.col("rating_count").cast("int")).alias("rating_count"),
        F.when(is_feed, F.size(feed)).otherwise(F.lit(None).cast("int")).alias("new_reviews_count"))
    target = existing if existing is not None else rows.where(F.lit(False))
    out = insert_ignore(rows, target, ["app", "source", "snapshot_date"],
                        order=["observed_at", "_tb"] if tiebreak else ["observed_at"])
    return out.drop("_tb") if tiebreak else out
