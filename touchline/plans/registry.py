"""Query registry: each registered query is ``fn(spark, sf_dir) -> DataFrame``
with an optional DuckDB oracle SQL over the raw driver views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.bindings import DriverTables
from .oracle_bindings import with_bindings

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
BODIES: dict[str, str] = {}       # the oracles without their binding CTEs, for reuse in others


def register(name: str, sql: str | None = None, tables: tuple[str, ...] = ()):
    """Register ``fn(t: DriverTables) -> DataFrame`` under ``name``; ``sql`` is
    the oracle body, prefixed with the binding CTEs listed in ``tables``."""
    def deco(fn: Callable[[DriverTables], DataFrame]) -> Callable[[DriverTables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(DriverTables(spark, sf_dir))
        if sql is not None:
            BODIES[name] = sql.strip()
            ORACLES[name] = with_bindings(sql, *tables) if tables else sql.strip()
        return fn
    return deco


def load_all() -> None:
    from . import q_events, q_metrics, q_attribution, q_funnel, q_segments  # noqa: F401
    from . import q_monitor, q_alerts, q_outbox, q_brand, q_ingest, q_streaming  # noqa: F401
