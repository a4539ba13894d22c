"""The same state kept by streams: pages seen within a week, counts by hour, events as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_of(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_seen(stream: DataFrame, keys: list[str], at: str, days: int = 7) -> DataFrame:
    """Rows whose key was not seen for so many days of event time; state older than that is dropped."""
    return stream.withWatermark(at, f"{days} days").dropDuplicatesWithinWatermark(keys)


def hourly_counts(stream: DataFrame, at: str, by: str, late: str = "2 hours") -> DataFrame:
    """Counts by hour and kind, for rows that are late by no more than ``late``."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 hour").alias("hour"), by).agg(F.count("*").alias("n")).select(F.col("hour.start").alias("hour"), by, "n")


def run_once(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Takes all that has arrived and stops; the next call goes on from there."""
    result.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
