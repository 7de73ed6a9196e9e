"""Structured Streaming over a folder of the change log (an extension: the batch engine does not need it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.schema import KV_LOG


def changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(KV_LOG).parquet(path)


def latest(stream: DataFrame) -> DataFrame:
    """The newest version of each key (update or complete mode)."""
    newest = F.max_by(F.struct("op", "value", "expires_at"), F.struct("seq", "ord")).alias("s")
    return stream.groupBy("key").agg(newest).select("key", "s.*")


def windowed(points: DataFrame, width: str, late: str) -> DataFrame:
    """Counts by event-time window of points(ts, series, value); rows later than ``late`` are dropped."""
    return points.withWatermark("ts", late).groupBy(F.window("ts", width), "series").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("high"))
