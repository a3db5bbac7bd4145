"""Payloads that keep landing: each micro-batch is reconciled with the snapshot, which is all the state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def stream_json(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(path)


def reconcile_stream(batches: DataFrame, snapshot_dir: str, step: Callable[[DataFrame | None, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Apply step(stored, batch) to each batch and write the result as snapshot_dir/v=<batch>.

    A batch that runs again after a failure reads the version before it and overwrites its own, so
    the result is the same; versions before that are deleted.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = spark.read.parquet(f"{snapshot_dir}/v={number - 1}") if number else None
        step(stored, batch).write.mode("overwrite").parquet(f"{snapshot_dir}/v={number}")
        if number > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{snapshot_dir}/v={number - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return batches.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
