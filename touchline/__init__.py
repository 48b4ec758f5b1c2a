"""touchline — marketing-attribution analytics as Spark DataFrame jobs.

Every operator takes DataFrames plus plain parameters and returns a DataFrame;
nothing is collected to the driver. Sub-packages:

* ``sources``   — table schemas and the bindings that derive model tables
                  (touches, conversions, events, ...) from the driver parquet.
* ``functions`` — Column-expression helpers (campaign-name parsing, channel
                  inference, rounding rules, domain / mention extraction).
* ``operators`` — the operator families (identity, as-of kernel, attribution,
                  spend/LTV metrics, event analytics, campaign funnel,
                  segments, stream health, alerts, outbox, brand, ingest).
* ``streaming`` — Structured Streaming forms of the ingest operators.
* ``plans``     — the registered query catalog and its DuckDB oracle SQL.
"""

__version__ = "0.1.0"
