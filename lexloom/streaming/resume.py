"""Resumable incremental processing: an append-only result log, and a stream that handles each key once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def todo(items: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Items whose key is not in the log yet."""
    return items.join(log.select(key), key, "left_anti")


def stream_once(
    spark: SparkSession, source: str, schema, key: str, time: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, delay: str = "1 hour"
) -> None:
    """Read new Parquet files below `source`, drop keys already seen, transform, append to `target`; ends when all files are read.

    Run again with the same checkpoint it goes on where it stopped. The state of seen keys is
    bounded by the watermark: a key that comes again more than `delay` later than the newest
    time counts as new, and a first delivery as late as that is still handled by `latest`.
    """
    s = spark.readStream.schema(schema).parquet(source)
    s = s.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    s = transform(s) if transform else s
    # each batch is committed as files and in the checkpoint: at least once, exactly once in the sink's log
    s.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(log: DataFrame, key: str, time: str) -> DataFrame:
    """The log as a table: of several deliveries of a key the last one. Aggregates before the shuffle."""
    rest = [c for c in log.columns if c not in (key, time)]
    return log.groupBy(key).agg(F.max(F.struct(time, *rest)).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in (time, *rest)])


def stream_batches(spark: SparkSession, source: str, schema, handle: Callable[[DataFrame, int], None], checkpoint: str, max_files: int = 1) -> None:
    """Micro-batches through `handle(frame, batch_id)`, for work with side effects; committed after each."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    s.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
