"""Conversion-upload outbox (P1–P6): pending purchases and leads, the
per-event payload, consecutive upload batches and acknowledgement handling.
Sending is not built — the outbox ends at payload batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import global_row_number
from ..functions.text import js_trim

# Events per upload request and the currency code.
BATCH_SIZE = 500
CURRENCY = "INR"


def epoch_seconds(ts: Column) -> Column:
    """Unix seconds of a wall-clock UTC ``timestamp_ntz`` (zone independent)."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def pii_hash(c: Column) -> Column:
    """SHA-256 hex of the trimmed, lower-cased value."""
    return F.sha2(F.lower(js_trim(c.cast("string"))), 256)


def _latest_cookie(touches: DataFrame, key: str) -> DataFrame:
    """Per key, the fbc/fbp of the latest touch carrying either (one row per
    key, a partial aggregate)."""
    t = touches.where(F.col(key).isNotNull() & (F.col("fbc").isNotNull() | F.col("fbp").isNotNull()))
    return (t.groupBy("app", key)
            .agg(F.max(F.struct("occurred_at", "id", "fbc", "fbp")).alias(f"_by_{key}")))


def pending_purchases(conversions: DataFrame, touches: DataFrame, app: str) -> DataFrame:
    """Resolved, not yet uploaded purchases of ``app``, oldest first, with
    the fbc/fbp of the latest touch that shares the session **or** the user
    (no time bound). The OR-lookup is two equi-joins against one-row-per-key
    aggregates; the later of the two candidates wins."""
    c = conversions.where((F.col("app") == app) & F.col("capi_uploaded_at").isNull()
                          & F.col("resolved_at").isNotNull())
    t = touches.where(F.col("app") == app)
    j = c
    for key in ("session_id", "user_id"):
        # a row without the key gets a key of its own, so such rows spread over all tasks
        by = _latest_cookie(t, key).select(F.col(key).cast("string").alias("_key"), f"_by_{key}")
        own = F.concat(F.lit("\x00"), F.xxhash64("order_id").cast("string"))
        j = j.withColumn("_key", F.coalesce(F.col(key).cast("string"), own)).join(by, "_key", "left").drop("_key")
    best = F.greatest(F.col("_by_session_id"), F.col("_by_user_id"))
    return (j.withColumn("fbc", best["fbc"]).withColumn("fbp", best["fbp"])
            .drop("_by_session_id", "_by_user_id").orderBy("occurred_at", "order_id"))


def purchase_payload(pending: DataFrame) -> DataFrame:
    """One Purchase event per row — flat columns plus the JSON event.

    Message-click orders (a ``ctwa_clid``) use the messaging envelope; others
    are ``app`` when the action source is ``app`` else ``website``. The user
    id and city are hashed; cookie ids are raw; absent ids are omitted."""
    ctwa = F.col("ctwa_clid") if "ctwa_clid" in pending.columns else F.lit(None).cast("string")
    src = F.col("action_source") if "action_source" in pending.columns else F.lit(None).cast("string")
    has_ctwa = ctwa.isNotNull() & (ctwa != "")
    uid = F.col("user_id").cast("string")
    ext = F.when(uid.isNotNull() & (uid != ""), pii_hash(uid))
    ct = F.when(F.col("city").isNotNull() & (F.col("city") != ""), pii_hash(F.col("city")))
    fbc = F.when(F.col("fbc") != "", F.col("fbc"))
    fbp = F.when(F.col("fbp") != "", F.col("fbp"))
    action = F.when(has_ctwa, F.lit("business_messaging")).when(src == "app", F.lit("app")).otherwise(F.lit("website"))
    flat = pending.select(
        F.lit("Purchase").alias("event_name"), epoch_seconds(F.col("occurred_at")).alias("event_time"),
        F.col("order_id").alias("event_id"), action.alias("action_source"),
        F.when(has_ctwa, F.lit("whatsapp")).alias("messaging_channel"),
        ext.alias("external_id_hash"), ct.alias("ct_hash"), fbc.alias("fbc"), fbp.alias("fbp"),
        F.when(has_ctwa, ctwa).alias("ctwa_clid"), F.col("value_inr").cast("double").alias("value"),
        F.lit(CURRENCY).alias("currency"), F.col("app"), F.col("occurred_at"))
    user_data = F.struct(F.when(F.col("external_id_hash").isNotNull(), F.array("external_id_hash")).alias("external_id"),
                         F.when(F.col("ct_hash").isNotNull(), F.array("ct_hash")).alias("ct"),
                         "fbc", "fbp", "ctwa_clid")
    event = F.struct("event_name", "event_time", "event_id", "action_source", "messaging_channel",
                     user_data.alias("user_data"),
                     F.struct(F.col("value"), F.col("currency")).alias("custom_data"))
    return flat.withColumn("payload", F.to_json(event))   # to_json drops NULL fields


def pending_leads(leads: DataFrame, app: str) -> DataFrame:
    """Leads not uploaded yet, oldest first."""
    return (leads.where((F.col("app") == app) & F.col("capi_uploaded_at").isNull())
            .select("app", "id", "ctwa_clid", "wa_phone_hash", "occurred_at").orderBy("occurred_at", "id"))


def lead_payload(pending: DataFrame) -> DataFrame:
    """One Lead event per row (``lead-<clid>`` id, messaging envelope,
    the already-hashed phone passed through)."""
    flat = pending.select(
        F.lit("Lead").alias("event_name"), epoch_seconds(F.col("occurred_at")).alias("event_time"),
        F.concat(F.lit("lead-"), F.col("ctwa_clid")).alias("event_id"),
        F.lit("business_messaging").alias("action_source"), F.lit("whatsapp").alias("messaging_channel"),
        F.col("ctwa_clid"), F.when(F.col("wa_phone_hash") != "", F.col("wa_phone_hash")).alias("ph"),
        "app", "id", "occurred_at")
    user_data = F.struct("ctwa_clid", F.when(F.col("ph").isNotNull(), F.array("ph")).alias("ph"))
    return flat.withColumn("payload", F.to_json(F.struct("event_name", "event_time", "event_id", "action_source",
                                                         "messaging_channel", user_data.alias("user_data"))))


def batch_outbox(rows: DataFrame, order_cols: list[str], size: int = BATCH_SIZE,
                 key_col: str | None = None) -> DataFrame:
    """P5: consecutive batches of ``size`` per app in ``order_cols`` order:
    ``(app, batch, n, event_ids, payloads, keys)``. ``keys`` are the rows' own
    ids for the acknowledgement (``key_col``, the event id where not given: a
    lead's event id is not its row's id). Row numbers per app come from the
    distributed ranking (an app can hold most of the rows); each batch list is
    bounded by ``size``."""
    key = F.col(key_col) if key_col else F.col("event_id")
    ranked = global_row_number(rows.withColumn("row_key", key), ["app"], order_cols, out="_rn")
    b = ranked.withColumn("batch", F.floor((F.col("_rn") - 1) / size).cast("long"))
    return (b.groupBy("app", "batch")
            .agg(F.count(F.lit(1)).cast("int").alias("n"),
                 F.sort_array(F.collect_list(F.struct("_rn", "event_id", "payload", "row_key"))).alias("_items"))
            .select("app", "batch", "n", F.transform("_items", lambda x: x["event_id"]).alias("event_ids"),
                    F.transform("_items", lambda x: x["payload"]).alias("payloads"),
                    F.transform("_items", lambda x: x["row_key"]).alias("keys")))


def apply_acks(rows: DataFrame, batches: DataFrame, acks: DataFrame, now: str,
               key: str = "order_id", mark: str = "capi_uploaded_at") -> DataFrame:
    """Mark rows uploaded (``mark = now``) only for accepted batches that
    come before the app's first failed batch; later batches stay pending.
    ``key`` is the column of ``rows`` that the batches' ``keys`` hold: the order
    id of purchases, the id of leads. ``acks`` has ``(app, batch, ok)``; ``batches`` is P5's output."""
    first_fail = (acks.where(~F.col("ok")).groupBy("app").agg(F.min("batch").alias("_fail")))
    accepted = (acks.where(F.col("ok")).join(first_fail, "app", "left")
                .where(F.col("_fail").isNull() | (F.col("batch") < F.col("_fail"))).select("app", "batch"))
    done = (batches.join(accepted, ["app", "batch"])
            .select("app", F.explode("keys").alias(key)).distinct().withColumn("_done", F.lit(True)))
    return (rows.join(done, ["app", key], "left")
            .withColumn(mark, F.when(F.col("_done"), F.lit(now).cast("timestamp_ntz")).otherwise(F.col(mark)))
            .drop("_done"))
