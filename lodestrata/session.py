"""Session settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC, so that times in microseconds mean the same everywhere; adaptive execution splits skewed joins and sizes shuffles.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true"}


def build(master: str | None = None, name: str = "lodestrata", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()
