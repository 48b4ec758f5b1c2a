"""Explicit schemas of the model tables and of the landed ingest payloads.

Every table is declared once here (a ``StructType`` plus its key); landed
JSON batches are read with these schemas — never inferred — so a malformed
field becomes NULL and is caught by the validators instead of silently
changing a column type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Table columns and keys of the data model (types in Spark DDL).
TABLES: dict[str, tuple[str, list[str]]] = {
    "ad_entity": ("id bigint, app string, channel string, level string, external_id string, "
                  "parent_external_id string, name string, city string, category string, objective string, "
                  "status string, current_daily_budget_inr decimal(14,2), currency string, raw string, "
                  "created_at timestamp_ntz, updated_at timestamp_ntz",
                  ["app", "channel", "level", "external_id"]),
    "ad_performance_daily": ("app string, ad_entity_id bigint, stat_date date, channel string, "
                             "spend_inr decimal(14,2), impressions bigint, clicks bigint, conversions decimal(14,2), "
                             "conv_value_inr decimal(14,2), ingested_at timestamp_ntz",
                             ["app", "ad_entity_id", "stat_date"]),
    "attribution_touch": ("id bigint, app string, occurred_at timestamp_ntz, received_at timestamp_ntz, "
                          "channel string, fbclid string, gclid string, gbraid string, wbraid string, fbc string, "
                          "fbp string, ctwa_clid string, wa_phone_hash string, utm_source string, utm_medium string, "
                          "utm_campaign string, utm_content string, utm_term string, touch_type string, "
                          "session_id string, user_id bigint, landing_url string, referrer string, consent boolean, "
                          "raw string", []),
    "conversion": ("id bigint, app string, order_id string, user_id bigint, occurred_at timestamp_ntz, "
                   "received_at timestamp_ntz, value_inr decimal(10,2), is_first_order boolean, city string, "
                   "category string, action_source string, session_id string, ctwa_clid string, "
                   "messaging_channel string, attributed_channel string, attributed_entity_id bigint, "
                   "attribution_model string, attribution_outcome string, resolved_at timestamp_ntz, "
                   "capi_uploaded_at timestamp_ntz", ["app", "order_id"]),
    "identity_link": ("id bigint, app string, session_id string, user_id bigint, linked_at timestamp_ntz",
                      ["app", "session_id", "user_id"]),
    "app_event": ("event_id string, app string, event_name string, occurred_at timestamp_ntz, "
                  "received_at timestamp_ntz, session_id string, user_id bigint, platform string, "
                  "app_version string, props string", ["event_id", "occurred_at"]),
    "lead_event": ("id bigint, app string, ctwa_clid string, wa_phone_hash string, lead_ref string, "
                   "occurred_at timestamp_ntz, capi_uploaded_at timestamp_ntz, created_at timestamp_ntz",
                   ["app", "ctwa_clid"]),
    "event_registry": ("id bigint, app string, source string, event_name string, description string, "
                       "expected_frequency string, is_active boolean, created_at timestamp_ntz, "
                       "updated_at timestamp_ntz", ["app", "source", "event_name"]),
    "segment": ("id bigint, app string, slug string, name string, definition string, "
                "refresh_interval_minutes int, status string, is_system boolean, last_refreshed_at timestamp_ntz, "
                "last_refresh_ms int, last_count int, last_error string", ["app", "slug"]),
    "segment_membership": ("segment_id bigint, user_id bigint, computed_at timestamp_ntz", ["segment_id", "user_id"]),
    "geo_observation": ("id bigint, app string, run_at timestamp_ntz, engine string, prompt_key string, "
                        "prompt string, brand_mentioned boolean, position int, cited_url string, "
                        "competitors array<string>, raw_response string", []),
    "review_observation": ("app string, source string, snapshot_date date, observed_at timestamp_ntz, "
                           "rating_avg decimal(3,2), rating_count int, new_reviews_count int, raw string",
                           ["app", "source", "snapshot_date"]),
    "alert": ("id bigint, app string, fired_at timestamp_ntz, severity string, rule_key string, scope string, "
              "metric string, observed decimal(14,2), threshold decimal(14,2), message string, "
              "acknowledged_at timestamp_ntz", []),
    "decision": ("id bigint, app string, proposed_at timestamp_ntz, source string, channel string, "
                 "entity_level string, external_id string, state_snapshot string, action_type string, "
                 "action_params string, mode string, status string, reason string, correlation_id string, "
                 "approved_by string, approved_at timestamp_ntz, executed_at timestamp_ntz, result string", []),
}

# Landed ingest payloads (JSON lines), before validation and defaults.
PAYLOADS: dict[str, str] = {
    "conversion": ("app string, order_id string, user_id bigint, value_inr decimal(10,2), is_first_order boolean, "
                   "city string, category string, action_source string, occurred_at timestamp_ntz, "
                   "session_id string, ctwa_clid string, messaging_channel string"),
    "touch": ("app string, session_id string, user_id bigint, occurred_at timestamp_ntz, channel string, "
              "touch_type string, gclid string, fbclid string, gbraid string, wbraid string, fbc string, fbp string, "
              "ctwa_clid string, wa_phone_hash string, utm_source string, utm_medium string, utm_campaign string, "
              "utm_content string, utm_term string, landing_url string, referrer string, consent boolean, raw string"),
    "lead": "app string, ctwa_clid string, wa_phone_hash string, lead_ref string, occurred_at timestamp_ntz",
    "event": ("event_id string, app string, event_name string, occurred_at timestamp_ntz, received_at timestamp_ntz, "
              "session_id string, user_id bigint, platform string, app_version string, props string"),
    "beacon": ("session_id string, touch_type string, utm_source string, utm_medium string, utm_campaign string, "
               "utm_content string, utm_term string, gclid string, fbclid string, gbraid string, wbraid string, "
               "fbc string, fbp string, landing_url string, referrer string, occurred_at string, consent boolean"),
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table][0])


def key(table: str) -> list[str]:
    return list(TABLES[table][1])


def read_landed(spark: SparkSession, path: str, payload: str) -> DataFrame:
    """Read landed JSON lines of one payload kind with its explicit schema;
    unparseable fields become NULL (PERMISSIVE) for the validators to flag."""
    return (spark.read.schema(StructType.fromDDL(PAYLOADS[payload])).option("mode", "PERMISSIVE")
            .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]['Z']").json(path))
