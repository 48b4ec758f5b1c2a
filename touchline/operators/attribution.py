"""Last-touch attribution (A1–A3).

A1 is a two-tier as-of lookup (same user first, else same session) on the
as-of kernel; A2 maps the winning touch to an ad entity through two lookups
pre-reduced to one row per key; A3 labels every pending conversion
``matched`` / ``organic`` / ``no_touch``. The reference resolves 500
conversions per run row by row; here every pending conversion is resolved
in one set-oriented job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import infer_channel, infer_channel_from_source, parse_campaign_name
from .asof import asof_last, choose_mode

CLICK_IDS = ("gclid", "gbraid", "wbraid", "fbclid", "fbc")
TOUCH_COLS = ("id", "occurred_at", "received_at", "channel", "utm_source", "utm_medium", "utm_campaign",
              "gclid", "gbraid", "wbraid", "fbclid", "fbc", "fbp", "session_id", "user_id", "touch_type")
TOUCH_PAYLOAD = ("channel", "utm_source", "utm_medium", "utm_campaign", "gclid", "gbraid", "wbraid", "fbclid", "fbc")


def _with_touch_cols(touches: DataFrame) -> DataFrame:
    missing = [c for c in TOUCH_COLS if c not in touches.columns]
    for c in missing:
        touches = touches.withColumn(c, F.lit(None).cast("string"))
    return touches


def last_touch(conversions: DataFrame, touches: DataFrame, app: str, lookback_days: int = 7,
               bucket_hours: int | None | str = "lookback", mode: str | None = None) -> DataFrame:
    """A1: conversions of ``app`` plus ``touch`` (struct of the winning touch
    or NULL) and ``tier`` (``user`` / ``session`` / NULL).

    Window ``[t − L, t]`` inclusive; latest by ``occurred_at, received_at,
    id``. The user tier runs first; the session tier runs over its output, so
    no join between tiers is needed.
    """
    conv = conversions.where(F.col("app") == app)
    t = _with_touch_cols(touches.where(F.col("app") == app))
    if mode is None and bucket_hours == "lookback":
        mode = choose_mode([(df, ["user_id", "session_id"], "occurred_at") for df in (conv, t)], lookback_days)
    # carried through the sweep: what entity mapping (A2) and callers read
    cols = [c for c in TOUCH_PAYLOAD if c not in ("occurred_at", "received_at", "id")]
    common = dict(target_ts="occurred_at", target_id="id", source_ts="occurred_at",
                  source_tiebreak=["received_at", "id"], source_cols=cols,
                  lookback_days=lookback_days, bucket_hours=bucket_hours, mode=mode)
    by_user = asof_last(conv, t, target_key="user_id", source_key="user_id", out="_t_user", **common)
    sess = F.when(F.col("_t_user").isNull(), F.nullif(F.col("session_id"), F.lit("")))
    by_session = asof_last(by_user, t, target_key=sess, source_key=F.nullif(F.col("session_id"), F.lit("")),
                           out="_t_session", **common)
    return (by_session
            .withColumn("tier", F.when(F.col("_t_user").isNotNull(), F.lit("user"))
                        .when(F.col("_t_session").isNotNull(), F.lit("session")))
            .withColumn("touch", F.coalesce("_t_user", "_t_session"))
            .drop("_t_user", "_t_session"))


def entity_lookups(entities: DataFrame, app: str) -> tuple[DataFrame, DataFrame]:
    """One row per lookup key, lowest entity id wins (deterministic LIMIT 1)."""
    e = entities.where(F.col("app") == app)
    by_name = (e.where(F.col("name").isNotNull())
               .groupBy("channel", F.lower("name").alias("name_key")).agg(F.min("id").alias("by_name_id")))
    by_parsed = (e.where(F.col("city").isNotNull() & F.col("category").isNotNull())
                 .groupBy("channel", "city", "category").agg(F.min("id").alias("by_parsed_id")))
    return by_name, by_parsed


def map_touch_to_entity(df: DataFrame, entities: DataFrame, app: str, touch: str | None = "touch") -> DataFrame:
    """A2: add ``mapped_channel`` and ``mapped_entity_id`` for the touch in
    struct column ``touch`` (or, with ``touch=None``, the row's own touch
    columns). Channel = click-id inference, else utm_source inference (the
    stored channel is not read). Match 1: lower(name) = lower(utm_campaign)
    in the channel; match 2: parsed city + category in the channel."""
    prefix = "" if touch is None else f"{touch}."
    ch = F.coalesce(infer_channel(prefix), infer_channel_from_source(prefix + "utm_source"))
    camp = F.col(prefix + "utm_campaign")
    parsed = parse_campaign_name(camp)
    usable = ch.isNotNull() & camp.isNotNull() & (camp != "")
    # a row without a key gets one of its own, so such rows spread over all tasks
    own = F.concat(F.lit("\x00"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    d = (df.withColumn("_ch", F.coalesce(F.when(usable, ch), own))
         .withColumn("_name_key", F.coalesce(F.when(usable, F.lower(camp)), own))
         .withColumn("_p", parsed))
    by_name, by_parsed = entity_lookups(entities, app)
    d = d.join(by_name.withColumnRenamed("channel", "_ch").withColumnRenamed("name_key", "_name_key"),
               ["_ch", "_name_key"], "left")
    pk = by_parsed.select(F.col("channel").alias("_ch"), F.col("city").alias("_pcity"),
                          F.col("category").alias("_pcat"), "by_parsed_id")
    d = (d.withColumn("_pcity", F.coalesce(F.when(F.col("_p.parsed_ok"), F.col("_p.city")), own))
         .withColumn("_pcat", F.when(F.col("_p.parsed_ok"), F.col("_p.category")))
         .join(pk, ["_ch", "_pcity", "_pcat"], "left"))
    ent = F.coalesce("by_name_id", "by_parsed_id")
    return (d.withColumn("mapped_entity_id", ent)
            .withColumn("mapped_channel", F.when(ent.isNotNull(), F.col("_ch")))
            .drop("_ch", "_name_key", "_p", "_pcity", "_pcat", "by_name_id", "by_parsed_id"))


def resolve_attribution(conversions: DataFrame, touches: DataFrame, entities: DataFrame, app: str,
                        lookback_days: int = 7, already_resolved: DataFrame | None = None,
                        resolved_at: str | None = None, bucket_hours: int | None | str = "lookback",
                        mode: str | None = None) -> DataFrame:
    """A3: attribution result rows keyed ``(app, order_id)`` for every
    conversion not yet in ``already_resolved`` (idempotent re-runs)."""
    pending = conversions.where(F.col("app") == app)
    if already_resolved is not None:
        pending = pending.join(already_resolved.select("app", "order_id"), ["app", "order_id"], "left_anti")
    lt = last_touch(pending, touches, app, lookback_days, bucket_hours, mode)
    m = map_touch_to_entity(lt, entities, app)
    outcome = (F.when(F.col("touch").isNull(), F.lit("no_touch"))
               .when(F.col("mapped_entity_id").isNotNull(), F.lit("matched")).otherwise(F.lit("organic")))
    when = F.lit(resolved_at).cast("timestamp_ntz") if resolved_at else F.lit(None).cast("timestamp_ntz")
    return m.select(*[c for c in pending.columns],
                    F.col("mapped_entity_id").cast("bigint").alias("attributed_entity_id"),
                    F.col("mapped_channel").alias("attributed_channel"),
                    F.lit("last_touch").alias("attribution_model"), outcome.alias("attribution_outcome"),
                    F.col("touch.id").alias("attributed_touch_id"), when.alias("resolved_at"))
