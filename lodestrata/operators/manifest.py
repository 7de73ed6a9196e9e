"""A manifest of data files as a table: file, level, first_key, last_key, bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.plans import ranged


def of_log(log: DataFrame, commits: int, levels: int) -> DataFrame:
    """Files of ``commits`` commits each, dealt to levels in turn."""
    number = F.floor(F.col("seq") / commits).cast("long")
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    files = log.groupBy(number.alias("file")).agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.sum(size).cast("long").alias("bytes"))
    return files.withColumn("level", (F.col("file") % levels).cast("int"))


def level_sizes(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("level").agg(F.sum("bytes").cast("long").alias("bytes"), F.count(F.lit(1)).alias("files"))


def sorted_level(manifest: DataFrame, level: int) -> DataFrame:
    return manifest.where(F.col("level") == level).orderBy("first_key", "file")


def overlapping(candidates: DataFrame, reference: DataFrame) -> DataFrame:
    """The candidates whose range of keys meets any of the reference.

    Among the reference files that begin at or before a candidate's end, the one that ends last decides: a running
    maximum along one order of both, not a join of ranges.
    """
    rows = candidates.select("file", "first_key", F.col("last_key").alias("at"), F.lit(None).cast("string").alias("ends")).unionByName(reference.select(F.lit(None).cast("long").alias("file"), F.lit(None).cast("string").alias("first_key"), F.col("first_key").alias("at"), F.col("last_key").alias("ends")))
    return ranged.running_max(rows, "at", "ends").where("file is not null and reached >= first_key").select("file")


def differences(manifest: DataFrame, listed: DataFrame) -> DataFrame:
    """file, issue: files that the manifest names but that are ``missing``, and ``orphan`` files that it does not name."""
    a, b = manifest.select("file").distinct(), listed.select("file").distinct()
    lost = a.join(b, "file", "left_anti").withColumn("issue", F.lit("missing"))
    return lost.unionByName(b.join(a, "file", "left_anti").withColumn("issue", F.lit("orphan")))
