"""The live view as a table of its own, so that reads do not group the whole log again.

It is written in ranges of the key, sorted, with statistics and a Bloom filter on the key: a range reads the row groups
that meet it, a key the few that may hold it.  A view is as of a commit; ``refreshed`` carries it on by the log after that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.plans import log as kv

#: Options of a view's files: row groups small enough to skip most of a file, and a Bloom filter on the key.
OPTIONS = {"parquet.block.size": str(8 << 20), "parquet.bloom.filter.enabled#key": "true"}


def write(newest: DataFrame, path: str) -> None:
    """Writes ``plans.log.latest`` (deletes included: they are needed to carry the view on)."""
    rows = newest.select("key", *kv.FIELDS, "seq")
    rows.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").options(**OPTIONS).parquet(path)


def read(spark: SparkSession, path: str, as_of: int) -> DataFrame:
    """Live keys of a view: conditions on ``key`` are pushed down to its files."""
    return spark.read.parquet(path).where(kv.is_live(as_of)).select("key", "value", "expires_at", "seq")


def refreshed(spark: SparkSession, path: str, since: DataFrame) -> DataFrame:
    """The newest versions of a view and of the log after its last commit."""
    old = spark.read.parquet(path).select("seq", F.lit(0).alias("ord"), "key", *kv.FIELDS)
    return kv.latest(old.unionByName(since.select(old.columns)))
