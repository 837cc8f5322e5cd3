"""Structured Streaming over observations: an addition, the stores themselves are batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def observations(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def counts(events: DataFrame) -> DataFrame:
    """Events by user and type; the same plan in batch and as a stream."""
    return events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


def windowed(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by type and window of event time, with a watermark that bounds the state."""
    e = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def first_seen(events: DataFrame, key: str, time: str = "ts", late: str = "2 hours") -> DataFrame:
    """The first event of each key within the watermark: known keys are skipped."""
    return events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key])
