"""Append-only logs as file-source streams: windowed usage totals and first-seen keys."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.session import shared_folder


def read_log_stream(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str, files_per_trigger: int | None = None
) -> DataFrame:
    """A parquet folder as a stream; only files matching ``pattern`` belong to the log."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def stream_usage(
    events: DataFrame, ts: str, width: str, lateness: str, by: Sequence[str], sums: dict[str, Column]
) -> DataFrame:
    """Totals per tumbling window and key; rows later than the watermark are dropped.

    State is one row per open window and key, so it is bounded by the lateness allowed.
    """
    return (
        events.withWatermark(ts, lateness)
        .groupBy(F.window(ts, width), *by)
        .agg(F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(n) for n, c in sums.items()])
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "calls", *sums)
    )


def stream_first_seen(log: DataFrame, ts: str, lateness: str, keys: Sequence[str]) -> DataFrame:
    """The first row of each key; a key is remembered for as long as the watermark allows."""
    return log.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(keys))


def run_available(stream: DataFrame, output: str | None = None) -> DataFrame:
    """Process everything there is now into parquet files and return them as a table.

    Rows go from the tasks to the shared folder; state and progress live beside them, so a
    rerun with the same ``output`` continues where the last one stopped.
    """
    spark = stream.sparkSession
    output = output or f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{output}/rows")
        .option("checkpointLocation", f"{output}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{output}/rows")


def run_updates(stream: DataFrame, keys: Sequence[str], output: str | None = None) -> DataFrame:
    """Process everything there is now and return the newest row of each key, open windows included.

    Each batch writes the rows that it changed to a folder of its own, so a batch that is repeated
    after a failure replaces what it wrote; the newest row of a key is that of its last batch.
    """
    spark = stream.sparkSession
    output = output or f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{output}/rows/batch={batch}")

    query = (
        stream.writeStream.foreachBatch(keep)
        .outputMode("update")
        .option("checkpointLocation", f"{output}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rest = [c for c in stream.columns if c not in keys]
    changed = spark.read.schema(schema).parquet(f"{output}/rows")
    newest = changed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row"))
    return newest.select(*keys, "row.*").select(*stream.columns)
