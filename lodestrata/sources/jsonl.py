"""JSON lines: export and import of a store; backups; folders of any file system that Spark reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _check(form: str) -> None:
    if form != "jsonl":
        raise ValueError(f"unknown format: {form}")


def write(live: DataFrame, path: str, form: str = "jsonl") -> int:
    """Lines ``{"k": key, "v": value}`` in key order (over the files by name); returns the number of entries written."""
    _check(form)
    spark = live.sparkSession
    lines = live.orderBy("key").select(F.to_json(F.struct(F.col("key").alias("k"), F.col("value").alias("v")), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode("overwrite").text(path)
    return spark.read.text(path).count()


def read(spark: SparkSession, path: str, form: str = "jsonl") -> DataFrame:
    """key, value of every line; blank lines are skipped."""
    _check(form)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", "k STRING, v STRING").alias("x")).select(F.col("x.k").alias("key"), F.col("x.v").alias("value"))


def batch(spark: SparkSession, path: str, as_of: int, ttl_us: int = 0, form: str = "jsonl") -> DataFrame:
    """The lines as a batch of puts, which expire ``ttl_us`` after ``as_of`` if that is positive."""
    expires = F.lit(as_of + ttl_us if ttl_us > 0 else None).cast("long")
    return read(spark, path, form).select(F.lit(0).alias("ord"), "key", F.lit("P").alias("op"), "value", expires.alias("expires_at"))


def backup(log: DataFrame, path: str) -> dict[str, int]:
    """A whole copy of the log, which needs nothing outside ``path``; returns the number of its files and their bytes."""
    log.write.mode("overwrite").parquet(path)
    found = files(log.sparkSession, path).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return {"files": found["files"], "bytes": found["bytes"]}


def restore(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes of the data files below ``path`` (their contents are not read)."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return listed.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
