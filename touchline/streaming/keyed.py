"""Streams that store each key once.

The keys seen live in the query's state store (RocksDB, whose changes are written to the
checkpoint): a micro-batch looks up its own keys and reads nothing of what is stored, so
its cost doesn't grow with the table, and a key that comes again after months is still
known. There is no watermark; nothing is dropped for being late. Keys are spread over
the shuffle partitions with which the checkpoint was begun. Of several rows of a key in one
micro-batch one is stored; a retried micro-batch replaces what it stored.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.batches import EVERY, BatchTable

# Spark's own state store on RocksDB, its changes uploaded instead of snapshots
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def keyed_state(spark: SparkSession):
    """The session with keys in RocksDB, for the start of a query, which keeps its settings."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def batch_sink(path: str, partition_by: tuple[str, ...] = (), every: int | None = EVERY, where: str | None = None):
    """A ``foreachBatch`` function storing each micro-batch as a part of a :class:`BatchTable`."""
    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.where(where) if where else batch
        BatchTable(batch.sparkSession, path, partition_by, every).write(rows, batch_id)
    return run


def start_keyed(rows: DataFrame, key: list[str], path: str, checkpoint: str, partition_by: tuple[str, ...] = (),
                every: int | None = EVERY, where: str | None = None, available_now: bool = True):
    """Start a query that stores the first row of each key of a stream in the table ``path``. Rows that fail
    ``where`` take their key but aren't stored (keys known before the stream began are fed in that way)."""
    with keyed_state(rows.sparkSession):
        w = rows.dropDuplicates(key).writeStream.foreachBatch(batch_sink(path, partition_by, every, where)).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start()
