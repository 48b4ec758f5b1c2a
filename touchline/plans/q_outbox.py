"""Registered outbox queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution as at
from ..operators import outbox as ob
from .params import APP, LOOKBACK_DAYS, NOW
from .q_attribution import RESOLVE_SQL_CTES
from .registry import register

UPLOADED_AT = "2024-01-30 00:00:00"


def _resolved(t):
    """A3 result with ``capi_uploaded_at`` set where ``id % 5 = 0``."""
    r = at.resolve_attribution(t.conversion, t.attribution_touch, t.ad_entity, APP, LOOKBACK_DAYS, resolved_at=NOW)
    return r.withColumn("capi_uploaded_at", F.when(F.col("id") % 5 == 0, F.lit(UPLOADED_AT).cast("timestamp_ntz")))


PENDING_SQL = f"""{RESOLVE_SQL_CTES},
 conv AS (SELECT r.*, CASE WHEN r.id % 5 = 0 THEN TIMESTAMP '{UPLOADED_AT}' END AS capi_uploaded_at FROM resolved r),
 tc AS (SELECT * FROM attribution_touch WHERE app = '{APP}' AND (fbc IS NOT NULL OR fbp IS NOT NULL)),
 m AS (SELECT c.order_id, tc.fbc, tc.fbp, row_number() OVER (PARTITION BY c.order_id ORDER BY tc.occurred_at DESC, tc.id DESC) AS rn
       FROM conv c JOIN tc ON tc.app = c.app AND ((c.session_id IS NOT NULL AND tc.session_id = c.session_id)
                                               OR (c.user_id IS NOT NULL AND tc.user_id = c.user_id))),
 pending AS (SELECT c.*, m.fbc, m.fbp FROM conv c LEFT JOIN m ON m.order_id = c.order_id AND m.rn = 1
             WHERE c.capi_uploaded_at IS NULL)"""

PAYLOAD_SQL = f"""{PENDING_SQL},
 payload AS (SELECT app, 'Purchase' AS event_name, CAST(floor(epoch(occurred_at)) AS BIGINT) AS event_time, order_id AS event_id,
   'website' AS action_source, CAST(NULL AS VARCHAR) AS messaging_channel,
   CASE WHEN user_id IS NOT NULL THEN sha256(lower(trim(CAST(user_id AS VARCHAR)))) END AS external_id_hash,
   CASE WHEN city IS NOT NULL AND city <> '' THEN sha256(lower(trim(city))) END AS ct_hash,
   nullif(fbc, '') AS fbc, nullif(fbp, '') AS fbp, CAST(NULL AS VARCHAR) AS ctwa_clid, CAST(value_inr AS DOUBLE) AS value,
   'INR' AS currency, occurred_at FROM pending)"""


@register("pending_purchases", f"""WITH {PENDING_SQL}
SELECT order_id, user_id, CAST(value_inr AS DOUBLE) AS value, occurred_at, city, fbc, fbp FROM pending ORDER BY occurred_at, order_id
""", ("conversion", "attribution_touch", "ad_entity"))
def pending_purchases(t):
    p = ob.pending_purchases(_resolved(t), t.attribution_touch, APP)
    return p.select("order_id", "user_id", F.col("value_inr").cast("double").alias("value"), "occurred_at", "city",
                    "fbc", "fbp")


def _payload(t):
    return ob.purchase_payload(ob.pending_purchases(_resolved(t), t.attribution_touch, APP))


@register("purchase_payload", f"""WITH {PAYLOAD_SQL}
SELECT event_name, event_time, event_id, action_source, messaging_channel, external_id_hash, ct_hash, fbc, fbp, ctwa_clid, value, currency,
  '{{"event_name":"Purchase","event_time":' || event_time || ',"event_id":"' || event_id || '","action_source":"' || action_source || '"'
    || coalesce(',"messaging_channel":"' || messaging_channel || '"', '') || ',"user_data":{{' || array_to_string(list_filter([
      '"external_id":["' || external_id_hash || '"]', '"ct":["' || ct_hash || '"]', '"fbc":"' || fbc || '"', '"fbp":"' || fbp || '"',
      '"ctwa_clid":"' || ctwa_clid || '"'], lambda x: x IS NOT NULL), ',') || '}},"currency":"' || currency || '"}}' AS payload
FROM payload""", ("conversion", "attribution_touch", "ad_entity"))
def purchase_payload(t):
    # the payload with its amount, whose printing differs between engines, compared as the column ``value``
    out = _payload(t).drop("app", "occurred_at")
    return out.withColumn("payload", F.regexp_replace("payload", r'"custom_data":\{"value":[^,]*,("currency":"[A-Z]+")\}', "$1"))


LEADS_SQL = f"""leads AS (SELECT app, id, ctwa_clid, wa_phone_hash, occurred_at FROM lead_event
  WHERE app = '{APP}' AND capi_uploaded_at IS NULL)"""


@register("pending_leads", f"WITH {LEADS_SQL} SELECT * FROM leads ORDER BY occurred_at, id", ("lead_event",))
def pending_leads(t):
    return ob.pending_leads(t.lead_event, APP)


LEAD_PAYLOAD_SQL = f"""{LEADS_SQL},
 lead_payload AS (SELECT 'Lead' AS event_name, CAST(floor(epoch(occurred_at)) AS BIGINT) AS event_time, 'lead-' || ctwa_clid AS event_id,
  'business_messaging' AS action_source, 'whatsapp' AS messaging_channel, ctwa_clid, nullif(wa_phone_hash, '') AS ph,
  app, id, occurred_at FROM leads)"""


@register("lead_payload", f"""WITH {LEAD_PAYLOAD_SQL}
SELECT event_name, event_time, event_id, action_source, messaging_channel, ctwa_clid, ph,
  '{{"event_name":"Lead","event_time":' || event_time || ',"event_id":"' || event_id || '","action_source":"business_messaging","messaging_channel":"whatsapp","user_data":{{"ctwa_clid":"'
    || ctwa_clid || '"' || coalesce(',"ph":["' || ph || '"]', '') || '}}}}' AS payload
FROM lead_payload""", ("lead_event",))
def lead_payload(t):
    return _lead_payload(t).drop("app", "id", "occurred_at")


def _lead_payload(t):
    return ob.lead_payload(ob.pending_leads(t.lead_event, APP))


@register("lead_acks", f"""WITH {LEAD_PAYLOAD_SQL},
 batches AS (SELECT id, (row_number() OVER (PARTITION BY app ORDER BY occurred_at, id) - 1) // 7 AS batch FROM lead_payload)
SELECT l.id, coalesce(l.capi_uploaded_at, CASE WHEN b.batch < 2 THEN TIMESTAMP '{NOW}' END) AS capi_uploaded_at
FROM lead_event l LEFT JOIN batches b ON b.id = l.id""", ("lead_event",))
def lead_acks(t):
    """P6 for leads, in batches of 7 of which the third fails: the first two are marked by the leads' own ids."""
    b = ob.batch_outbox(_lead_payload(t), ["occurred_at", "id"], 7, key_col="id")
    acks = b.select("app", "batch", (F.col("batch") != 2).alias("ok"))
    return ob.apply_acks(t.lead_event, b, acks, NOW, key="id").select("id", "capi_uploaded_at")


BATCH_SQL = f"""{PAYLOAD_SQL},
 ranked AS (SELECT app, event_id, occurred_at, row_number() OVER (PARTITION BY app ORDER BY occurred_at, event_id) AS rn FROM payload),
 batches AS (SELECT app, CAST(floor((rn - 1) / 500) AS BIGINT) AS batch, event_id, rn FROM ranked)"""


def _batches(t):
    return ob.batch_outbox(_payload(t), ["occurred_at", "event_id"], ob.BATCH_SIZE)


@register("outbox_batches", f"""WITH {BATCH_SQL}
SELECT app, batch, CAST(count(*) AS INT) AS n, arg_min(event_id, rn) AS first_event_id, arg_max(event_id, rn) AS last_event_id
FROM batches GROUP BY 1, 2""", ("conversion", "attribution_touch", "ad_entity"))
def outbox_batches(t):
    b = _batches(t)
    return b.select("app", "batch", "n", F.element_at("event_ids", 1).alias("first_event_id"),
                    F.element_at("event_ids", -1).alias("last_event_id"))


@register("outbox_acks", f"""WITH {BATCH_SQL}
SELECT c.order_id, coalesce(c.capi_uploaded_at, CASE WHEN b.batch = 0 THEN TIMESTAMP '{NOW}' END) AS capi_uploaded_at
FROM conv c LEFT JOIN batches b ON b.event_id = c.order_id""", ("conversion", "attribution_touch", "ad_entity"))
def outbox_acks(t):
    """Batch 1 of the app fails, so only batch 0 is marked (batch 2+ stay
    pending even when acknowledged)."""
    b = _batches(t)
    acks = b.select("app", "batch", (F.col("batch") != 1).alias("ok"))
    marked = ob.apply_acks(_resolved(t), b, acks, NOW)
    return marked.select("order_id", "capi_uploaded_at")
