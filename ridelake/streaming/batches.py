"""Replay-safe output of ``foreachBatch`` jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ridelake.streaming.state import PROVIDER, ROCKSDB

IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
Handler = Callable[[DataFrame, int], None]


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch's rows; a replay of the batch replaces them."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch_id")


def run_batches(
    stream: DataFrame, handler: Handler, checkpoint: str, output_mode: str = "append",
    reuse: bool = True, available_now: bool = True, interval: str = "1 minute", idle_batches: bool = True,
) -> StreamingQuery:
    """Start ``handler`` over the stream: until the present input is used up, or continuously.

    ``reuse`` keeps a micro-batch while a handler reads it more than once. Without ``idle_batches`` a micro-batch needs new
    rows: timers on processing time would ask for another one for ever, so they fire beside rows instead. State is kept in RocksDB, on the executors'
    disks with changes checkpointed, so it may outgrow memory.
    """
    spark = stream.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        if not reuse:
            handler(batch, batch_id)
            return
        batch.persist()
        try:
            handler(batch, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(handle).outputMode(output_mode).option(
        "checkpointLocation", checkpoint
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    # A started query keeps the settings of its start.
    settings = {PROVIDER: ROCKSDB, IDLE: str(idle_batches).lower()}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        return writer.trigger(**trigger).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
