"""Identity stitching (A4), identity edges (U3) and touch backfill (U4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import identity_key
from .asof import asof_last


def with_identity(rows: DataFrame, links: DataFrame, row_id: str, out: str = "id",
                  user_col: str = "user_id", session_col: str = "session_id", stitch: str = "all") -> DataFrame:
    """A4: add ``out = coalesce(user_id, linked user, 'sid:'||session)``.

    ``rows`` and ``links`` must already be scoped to one app (``links`` has
    ``session_id, user_id``). Left join on the session; a session linked to
    several users fans the row out (kept on purpose, SURVEY X2).

    Scale: identity_link grows with traffic, so this is a shuffle join (AQE
    turns it into a broadcast only when the measured side is small, and splits
    a hot session's partition). Rows without a session cannot match; their
    join key is replaced by a per-row sentinel so NULLs do not all hash into
    one shuffle partition.

    ``stitch="latest"`` keeps one user per session (the most recently linked
    one, by ``linked_at`` when present, else the highest user id) so a shared
    session no longer multiplies rows.
    """
    if stitch == "latest":
        order = F.struct("linked_at", "user_id") if "linked_at" in links.columns else F.col("user_id")
        links = links.groupBy("session_id").agg(F.max_by("user_id", order).alias("user_id"))
    elif stitch != "all":
        raise ValueError(stitch)
    lk = links.select(F.col("session_id").alias("_lk_session"), F.col("user_id").alias("_lk_user"))
    key = F.coalesce(F.col(session_col), F.concat(F.lit("\u0000"), F.col(row_id).cast("string")))
    joined = rows.withColumn("_jk", key).join(lk, F.col("_jk") == F.col("_lk_session"), "left")
    return (joined.withColumn(out, identity_key(user_col, "_lk_user", session_col))
            .drop("_jk", "_lk_session", "_lk_user"))


def link_identities(existing: DataFrame, *sources: DataFrame) -> DataFrame:
    """New ``(app, session_id, user_id)`` edges (insert-ignore).

    Each source contributes its rows that carry both a session and a user;
    the result is the edges not already in ``existing``."""
    cand = None
    for s in sources:
        e = (s.where(F.col("session_id").isNotNull() & (F.col("session_id") != "") & F.col("user_id").isNotNull())
             .select("app", "session_id", F.col("user_id").cast("bigint").alias("user_id")))
        cand = e if cand is None else cand.unionByName(e)
    return (cand.distinct()
            .join(existing.select("app", "session_id", "user_id"), ["app", "session_id", "user_id"], "left_anti"))


def backfill_touch_users(touches: DataFrame, bucket_hours: int | None = 24, mode: str | None = None) -> DataFrame:
    """U4: a touch stored without a user takes the user of the next touch of
    the same ``(app, session)`` that revealed one, in arrival order
    ``(received_at, id)`` — the sequential writer updates every earlier
    anonymous touch of the session when a revealing touch arrives, so the
    first revealer after an anonymous touch is the one that fills it.

    A forward as-of lookup on the bucketed kernel: a session with a huge
    number of touches is split across its time buckets.
    """
    key = F.concat_ws("\u0001", F.col("app"), F.col("session_id"))
    anon = touches.where(F.col("user_id").isNull() & F.col("session_id").isNotNull())
    known = touches.where(F.col("user_id").isNotNull() | F.col("session_id").isNull())
    revealers = touches.where(F.col("user_id").isNotNull() & F.col("session_id").isNotNull()) \
        .select(key.alias("_k"), "received_at", "id", F.col("user_id").alias("_u"))
    filled = asof_last(anon, revealers, target_key=key, target_ts="received_at", target_id="id",
                       source_key="_k", source_ts="received_at", source_tiebreak=["id"], source_cols=["_u"],
                       lookback_days=None, out="_rev", bucket_hours=bucket_hours,
                       target_tiebreak=["id"], forward=True, mode=mode)
    filled = filled.withColumn("user_id", F.col("_rev._u").cast(touches.schema["user_id"].dataType)).drop("_rev")
    return known.unionByName(filled.select(*touches.columns))
