"""Session helpers: a tuned local session for tests/bench, and the shared
checkpoint directory lookup for lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every touchline job assumes. AQE re-plans joins (broadcast when a
# side turns out small, skew-split hot partitions) and coalesces the shuffle
# output; the session zone is pinned so day buckets are reproducible.
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # coalesce shuffle output to the advisory partition size (not to tiny
    # partitions maximising parallelism) — the setting for shared clusters
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "touchline", driver_memory: str = "16g",
                  extra: dict | None = None) -> SparkSession:
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or cpus
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf.update({
        "spark.sql.shuffle.partitions": str(parts),
        "spark.default.parallelism": str(parts),
        "spark.driver.memory": driver_memory,
    })
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_FALLBACK_DIRS: dict[int, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and staged tables.

    This is ``spark.checkpoint.dir`` as configured by the platform (it cannot
    be changed at runtime). Where it is unset, a single-process ``local``
    master, as in tests, gets a folder of its own; on a cluster, where no
    folder of one machine would do, that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not d and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not d:
        key = id(sc)
        if key not in _FALLBACK_DIRS:
            _FALLBACK_DIRS[key] = tempfile.mkdtemp(prefix="touchline-ckpt-")
        d = _FALLBACK_DIRS[key]
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d
