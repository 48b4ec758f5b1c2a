"""Campaign-attributed full funnel (F1–F11), one row per campaign:
impressions → ad clicks → first-party clicks → installs → registrations →
add-to-cart → orders / revenue.

Plan shape (see ``campaign_funnel``):

* the entity side (F1/F2) is a dimension: two self-joins and one alias
  table, small enough for AQE to broadcast;
* touches, stage events and conversions are unioned *before* the identity
  stitch, so identity_link is shuffled once instead of three times;
* stage events and conversions share one as-of pass over the campaign
  touches (F8 + F10), instead of two range joins;
* the campaign universe (F3–F5) is capped at ``top`` rows and the per-campaign
  stage/order counts are joined onto it at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import day_window, identity_key
from .asof import asof_rows, choose_mode

# Funnel stage events in stage order.
STAGE_EVENTS = ["el_first_open", "el_signup", "el_add_to_cart"]
STAGE_COLUMNS = {"el_first_open": "installs", "el_signup": "registrations", "el_add_to_cart": "add_to_cart"}


@dataclass(frozen=True)
class FunnelFilters:
    app: str
    day_from: str
    day_to: str
    utm_campaign: str | None = None
    channel: str | None = None
    medium: str | None = None


def entity_campaign(entities: DataFrame, app: str) -> DataFrame:
    """every entity resolved to its campaign ancestor by two parent hops
    (join on app + channel + external_id; level is not part of the key)."""
    own = entities.where(F.col("app") == app)

    def kin(name: str) -> DataFrame:
        return own.select(*[F.col(c).alias(f"{name}_{c}") for c in ("app", "channel", "external_id", "parent_external_id", "name")])

    def child_of(below: str, above: str):
        col = lambda c: F.col(f"{below}_{c}" if below else c)
        return ((F.col(f"{above}_app") == col("app")) & (F.col(f"{above}_channel") == col("channel"))
                & (F.col(f"{above}_external_id") == col("parent_external_id")))
    j = own.join(kin("above"), child_of("", "above"), "left").join(kin("top"), child_of("above", "top"), "left")
    return j.select(F.col("id").alias("entity_id"), F.lower("external_id").alias("external_alias"),
                    F.lower("name").alias("name_alias"),
                    F.lower(F.coalesce("top_external_id", "above_external_id", "external_id")).alias("campaign_key"),
                    F.coalesce("top_name", "above_name", "name").alias("campaign_name"))


def campaign_alias(ec: DataFrame) -> DataFrame:
    """alias (lower external id or lower name) → one campaign; the lowest
    campaign key wins (then the lowest name). One pass over F1."""
    a = ec.select(F.explode(F.array("external_alias", "name_alias")).alias("alias"), "campaign_key", "campaign_name")
    best = a.where(F.col("alias").isNotNull()).groupBy("alias").agg(F.min(F.struct("campaign_key", "campaign_name")).alias("b"))
    return best.select("alias", F.col("b.campaign_key").alias("campaign_key"),
                       F.col("b.campaign_name").alias("campaign_name"))


def _resolve_campaign(touches: DataFrame, alias: DataFrame) -> DataFrame:
    ca = alias.select(F.col("alias").alias("_alias"), F.col("campaign_key").alias("ca_key"),
                      F.col("campaign_name").alias("ca_name"))
    return (touches.withColumn("_alias", F.lower("utm_campaign")).join(ca, "_alias", "left")
            .withColumn("campaign_key", F.coalesce("ca_key", "_alias")).drop("_alias"))


def touch_campaigns(touches: DataFrame, alias: DataFrame, f: FunnelFilters) -> DataFrame:
    """touch side of the universe, with first-party click counts."""
    t = touches.where((F.col("app") == f.app) & day_window("occurred_at", f.day_from, f.day_to)
                      & F.col("utm_campaign").isNotNull())
    if f.channel:
        t = t.where(F.col("channel") == f.channel)
    if f.medium:
        t = t.where(F.col("utm_medium") == f.medium)
    t = _resolve_campaign(t, alias)
    if f.utm_campaign:
        want = f.utm_campaign.lower()
        t = t.where((F.lower("utm_campaign") == want) | (F.lower("ca_name") == want))
    return (t.groupBy("campaign_key")
            .agg(F.min(F.coalesce("ca_name", "utm_campaign")).alias("utm_campaign"),
                 F.count_if(F.col("touch_type") == "first_party_click").cast("double").alias("first_party_clicks")))


def ad_campaigns(perf: DataFrame, entities: DataFrame, ec: DataFrame, f: FunnelFilters) -> DataFrame:
    """ad-side spend, impressions and clicks rolled up to the campaign."""
    p = perf.where((F.col("app") == f.app)
                   & F.col("stat_date").between(F.lit(f.day_from).cast("date"), F.lit(f.day_to).cast("date")))
    e = entities.select(F.col("id").alias("ad_entity_id"), F.col("channel").alias("e_channel"))
    j = (p.join(e, "ad_entity_id")
         .join(ec.withColumnRenamed("entity_id", "ad_entity_id"), "ad_entity_id")
         .where(F.col("campaign_name").isNotNull()))
    if f.utm_campaign:
        j = j.where(F.lower("campaign_name") == f.utm_campaign.lower())
    if f.channel:
        j = j.where(F.col("e_channel") == f.channel)
    return (j.groupBy("campaign_key")
            .agg(F.min("campaign_name").alias("utm_campaign"),
                 F.sum("impressions").cast("double").alias("impressions"),
                 F.sum("clicks").cast("double").alias("ad_clicks"),
                 F.sum("spend_inr").cast("double").alias("ad_spend_inr")))


def campaign_universe(tc: DataFrame, ac: DataFrame, f: FunnelFilters, top: int | None = None) -> DataFrame:
    """full outer join of the two sides (left join under a medium filter),
    ranked by first-party clicks + spend, then name; the first ``top`` if given."""
    how = "left" if f.medium else "full"
    j = tc.alias("tc").join(ac.alias("ac"), F.col("tc.campaign_key") == F.col("ac.campaign_key"), how)
    fpc = F.coalesce(F.col("tc.first_party_clicks"), F.lit(0.0))
    name = F.coalesce(F.col("tc.utm_campaign"), F.col("ac.utm_campaign"))
    u = (j.select(F.coalesce(F.col("tc.campaign_key"), F.col("ac.campaign_key")).alias("campaign_key"),
                     name.alias("utm_campaign"), fpc.cast("double").alias("first_party_clicks"),
                     F.col("ac.impressions").alias("impressions"), F.col("ac.ad_clicks").alias("ad_clicks"),
                     F.col("ac.ad_spend_inr").alias("ad_spend_inr"))
            .orderBy((F.col("first_party_clicks") + F.coalesce(F.col("ad_spend_inr"), F.lit(0.0))).desc(),
                     F.col("utm_campaign")))
    return u if top is None else u.limit(top)


def attributed_rows(touches: DataFrame, events: DataFrame, conversions: DataFrame, links: DataFrame,
                    alias: DataFrame, f: FunnelFilters, lookback_days: int,
                    bucket_hours: int | None | str = "lookback", mode: str | None = None) -> DataFrame:
    """Per campaign the attributed stage and order rows.

    Campaign touches (F6, request filters deliberately not applied, window
    widened back by the lookback), stage events and conversions (in window)
    are unioned and stitched to identities with ONE identity join, then go
    through ONE as-of pass (every stage event and conversion gets the
    identity's last campaign touch in ``[t − L, t]``). A single aggregate
    then keeps, per identity and stage, the first event's attribution (F7/F8)
    and, per conversion, one attribution even when its session fans out to
    several identities (F10). Rows without a touch drop out.

    Columns: ``kind`` (stage event name or ``order``), ``campaign_key``,
    ``value_inr`` (orders only).
    """
    lb_from = F.date_sub(F.lit(f.day_from).cast("date"), lookback_days).cast("timestamp_ntz")
    to_excl = F.date_add(F.lit(f.day_to).cast("date"), 1).cast("timestamp_ntz")
    t = (touches.where((F.col("app") == f.app) & (F.col("occurred_at") >= lb_from)
                       & (F.col("occurred_at") < to_excl) & F.col("utm_campaign").isNotNull()))
    t = _resolve_campaign(t, alias).select(
        F.lit("touch").alias("kind"), F.col("id").cast("string").alias("row_id"), "occurred_at",
        "session_id", "user_id", "campaign_key", F.lit(None).cast("decimal(10,2)").alias("value_inr"),
        F.col("id").cast("long").alias("touch_id"))
    e = (events.where((F.col("app") == f.app) & day_window("occurred_at", f.day_from, f.day_to)
                      & F.col("event_name").isin(*STAGE_EVENTS))
         .select(F.col("event_name").alias("kind"), F.col("event_id").cast("string").alias("row_id"),
                 "occurred_at", "session_id", "user_id", F.lit(None).cast("string").alias("campaign_key"),
                 F.lit(None).cast("decimal(10,2)").alias("value_inr"), F.lit(None).cast("long").alias("touch_id")))
    c = (conversions.where((F.col("app") == f.app) & day_window("occurred_at", f.day_from, f.day_to))
         .select(F.lit("order").alias("kind"), F.col("id").cast("string").alias("row_id"), "occurred_at",
                 "session_id", "user_id", F.lit(None).cast("string").alias("campaign_key"), "value_inr",
                 F.lit(None).cast("long").alias("touch_id")))
    rows = t.unionByName(e).unionByName(c)
    lk = links.where(F.col("app") == f.app).select(F.col("session_id").alias("_lk_s"),
                                                   F.col("user_id").alias("_lk_u"))
    jk = F.coalesce(F.col("session_id"), F.concat(F.lit("\u0000"), F.col("kind"), F.col("row_id")))
    stitched = (rows.withColumn("_jk", jk).join(lk, F.col("_jk") == F.col("_lk_s"), "left")
                .select("kind", "row_id", identity_key("user_id", "_lk_u", "session_id").alias("id"),
                        "occurred_at", "campaign_key", "value_inr", "touch_id")
                .where(F.col("id").isNotNull()))
    if mode is None and bucket_hours == "lookback":
        mode = choose_mode([(stitched, ["id"], "occurred_at")], lookback_days, sized_by=[rows, lk])
    hit = asof_rows(stitched, key="id", ts="occurred_at", is_source=F.col("kind") == "touch",
                    row_id=F.concat_ws("\u0001", "kind", "row_id", "id"), source_tiebreak=["touch_id"],
                    source_cols=["campaign_key"], lookback_days=lookback_days, out="touch",
                    bucket_hours=bucket_hours, mode=mode)
    is_order = F.col("kind") == "order"
    group = F.when(is_order, F.concat(F.lit("o\u0001"), F.col("row_id"))) \
        .otherwise(F.concat(F.lit("s\u0001"), F.col("kind"), F.lit("\u0001"), F.col("id")))
    has = F.col("touch").isNotNull()
    picked = (hit.groupBy(group.alias("_g"))
              .agg(F.first("kind").alias("kind"),
                   # stage: the identity's first event of the stage decides
                   F.min_by(F.col("touch.campaign_key"), F.struct("occurred_at", "row_id")).alias("_first"),
                   # order: one attribution per conversion, the latest touch wins
                   F.max_by(F.when(has, F.struct(F.col("touch.campaign_key").alias("k"), "value_inr")),
                            F.when(has, F.struct(F.col("touch.ts"), F.col("touch.touch_id")))).alias("_ord")))
    return (picked.select("kind",
                          F.when(F.col("kind") == "order", F.col("_ord.k")).otherwise(F.col("_first")).alias("campaign_key"),
                          F.when(F.col("kind") == "order", F.col("_ord.value_inr")).alias("value_inr"))
            .where(F.col("campaign_key").isNotNull()))


def stage_and_order_counts(attributed: DataFrame) -> DataFrame:
    """F9 + F10 counts: per campaign installs / registrations / add-to-cart
    (identities once per stage) and orders / revenue (every conversion)."""
    aggs = [F.count_if(F.col("kind") == ev).cast("double").alias(col) for ev, col in STAGE_COLUMNS.items()]
    aggs += [F.count_if(F.col("kind") == "order").cast("double").alias("orders"),
             F.sum(F.when(F.col("kind") == "order", F.col("value_inr"))).alias("revenue")]
    return attributed.groupBy("campaign_key").agg(*aggs)


def campaign_funnel(entities: DataFrame, perf: DataFrame, touches: DataFrame, events: DataFrame,
                    conversions: DataFrame, links: DataFrame, f: FunnelFilters, lookback_days: int = 7,
                    top: int | None = None, bucket_hours: int | None | str = "lookback",
                    mode: str | None = None) -> DataFrame:
    """the campaign funnel rows, best first."""
    ec = entity_campaign(entities, f.app)
    alias = campaign_alias(ec)
    universe = campaign_universe(touch_campaigns(touches, alias, f), ad_campaigns(perf, entities, ec, f), f, top)
    counts = stage_and_order_counts(
        attributed_rows(touches, events, conversions, links, alias, f, lookback_days, bucket_hours, mode))
    j = universe.join(counts, "campaign_key", "left")
    z = F.lit(0.0)
    return (j.select("utm_campaign", "impressions", "ad_clicks", "first_party_clicks",
                     *[F.coalesce(F.col(c), z).alias(c) for c in STAGE_COLUMNS.values()],
                     F.coalesce(F.col("orders"), z).alias("orders"),
                     F.coalesce(F.col("revenue").cast("double"), z).alias("revenue_inr"),
                     "ad_spend_inr")
            .orderBy((F.col("first_party_clicks") + F.coalesce(F.col("ad_spend_inr"), z)).desc(), "utm_campaign"))
