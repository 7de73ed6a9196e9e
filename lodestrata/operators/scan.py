"""Reads of live keys: ranges, prefixes, patterns, ends, neighbours, samples, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.plans import ranged
from lodestrata.plans.log import between, is_live


def scan(live: DataFrame, start: str | None = None, end: str | None = None, limit: int | None = None, reverse: bool = False) -> DataFrame:
    out = between(live, start, end).orderBy(F.desc("key") if reverse else F.asc("key"))
    return out if limit is None else out.limit(max(0, limit))


def prefix(live: DataFrame, start: str, limit: int | None = None) -> DataFrame:
    return scan(live.where(F.col("key").startswith(start)), limit=limit)


def tail(live: DataFrame, n: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """The last ``n`` keys, in ascending order."""
    return scan(live, start, end, n, reverse=True).orderBy("key")


def grep(live: DataFrame, pattern: str) -> DataFrame:
    """Rows whose key the regular expression finds."""
    return live.where(F.col("key").rlike(pattern)).orderBy("key")


def scan_filter(live: DataFrame, condition: Column) -> DataFrame:
    return live.where(condition).orderBy("key")


def ends(live: DataFrame) -> DataFrame:
    """First and last key with their values: one row."""
    pair = F.struct("key", "value")
    return live.agg(F.min(pair).alias("a"), F.max(pair).alias("b")).select(F.col("a.key").alias("first_key"), F.col("a.value").alias("first_value"), F.col("b.key").alias("last_key"), F.col("b.value").alias("last_value"))


def floor_ceiling(probes: DataFrame, live: DataFrame) -> DataFrame:
    """For each probe the largest key <= it and the smallest key >= it, by one order of probes and keys together."""
    both = live.select("key", F.lit(False).alias("asked")).union(probes.select(F.col("probe").alias("key"), F.lit(True)))
    near = ranged.around(both, "key", F.when(~F.col("asked"), F.col("key")))
    return near.where("asked").select(F.col("key").alias("probe"), F.col("below").alias("floor_key"), F.col("above").alias("ceiling_key"))


def multi_get(keys: DataFrame, live: DataFrame) -> DataFrame:
    """Every asked key with its value, null where absent."""
    return keys.join(live.select("key", "value"), "key", "left")


def batches(live: DataFrame, size: int) -> DataFrame:
    """Each key with its position and batch number in key order."""
    return ranged.numbered(live.select("key"), "key").select("key", "position", F.floor(F.col("position") / size).alias("batch"))


def followed(live: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """A cursor's steps: each key of a range with the next one."""
    return ranged.with_next(between(live, start, end).select("key"), "key")


def is_empty(live: DataFrame) -> DataFrame:
    """One row: whether there is no key; one is enough to tell."""
    return live.limit(1).agg((F.count(F.lit(1)) == 0).alias("is_empty"))


def key_stats(live: DataFrame) -> DataFrame:
    k, v = F.octet_length("key"), F.octet_length("value")
    return live.agg(F.count(F.lit(1)).alias("keys"), F.sum(k).alias("key_bytes"), F.sum(v).alias("value_bytes"), F.min(v).alias("min_value_bytes"), F.max(v).alias("max_value_bytes"))


def sample(live: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` keys by hash order: the same keys every time, without a pass to count."""
    return live.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "key"), 256), "key").limit(n).select("key")


def key_type(latest: DataFrame, as_of: int) -> DataFrame:
    """The state of each key that was ever written: string (it has a value), expired, or none (deleted)."""
    return latest.select("key", F.when(is_live(as_of), "string").when(F.col("op") == "P", "expired").otherwise("none").alias("kind"))
