"""The change log and its views: newest versions, live keys, ranges, snapshots.

``seq`` numbers commits, ``ord`` the operations of one commit; ``op`` is P (put) or D (delete); ``expires_at`` is in
microseconds, null for never.  The newest version of a key is found first; deletes and expiry are judged after that,
so an older version never comes back.  A grouped maximum of (seq, ord) is combined map-side: one pass, one shuffle of
at most one row a key and task, however often a key was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("op", "value", "expires_at")


def latest(log: DataFrame, *more: str) -> DataFrame:
    """The newest version of each key (key, op, value, expires_at, seq), tombstones included."""
    newest = F.max_by(F.struct(*FIELDS, "seq", *more), F.struct("seq", "ord")).alias("s")
    return log.groupBy("key").agg(newest).select("key", "s.*")


def is_live(as_of: int) -> Column:
    return (F.col("op") == "P") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of))


def live(log: DataFrame, as_of: int) -> DataFrame:
    return latest(log).where(is_live(as_of)).select("key", "value", "expires_at", "seq")


def between(df: DataFrame, start: str | None, end: str | None, column: str = "key") -> DataFrame:
    """start <= key < end; a bound that is None or empty is open.  On ``key`` it moves below the grouping to the scan."""
    if start:
        df = df.where(F.col(column) >= start)
    if end:
        df = df.where(F.col(column) < end)
    return df


def snapshot(log: DataFrame, seq: int) -> DataFrame:
    """The log as of commit ``seq``."""
    return log.where(F.col("seq") <= seq)


def append(log: DataFrame, batch: DataFrame) -> DataFrame:
    """``batch`` (ord, key, op, value, expires_at) as the next commit of ``log``."""
    last = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))  # one row
    return log.unionByName(batch.join(F.broadcast(last)).withColumn("seq", F.col("last") + 1).drop("last").select(log.columns))


def two_views(log: DataFrame, seq: int, as_of: int) -> DataFrame:
    """key, seen, value: what a key held at commit ``seq`` and what it holds now, from one grouped pass."""
    version, order = F.struct(*FIELDS), F.struct("seq", "ord")
    both = log.groupBy("key").agg(F.max_by(version, F.when(F.col("seq") <= seq, order)).alias("a"), F.max_by(version, order).alias("b"))

    def held(x: str) -> Column:
        return F.when((F.col(f"{x}.op") == "P") & (F.col(f"{x}.expires_at").isNull() | (F.col(f"{x}.expires_at") > as_of)), F.col(f"{x}.value"))

    return both.select("key", held("a").alias("seen"), held("b").alias("value"))


def merge_batches(first: DataFrame, second: DataFrame) -> DataFrame:
    """The operations of two batches as one, those of ``second`` after all of ``first``."""
    shift = first.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("shift"))  # one row
    return first.unionByName(second.join(F.broadcast(shift)).withColumn("ord", F.col("ord") + F.col("shift")).drop("shift"))


def batch_counts(batch: DataFrame) -> DataFrame:
    """One row: puts, deletes, and bytes of keys and values."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return batch.agg(F.count_if(F.col("op") == "P").alias("puts"), F.count_if(F.col("op") == "D").alias("deletes"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def record(log: DataFrame) -> DataFrame:
    """The log as checked records: seq, ord, payload, crc."""
    payload = F.concat_ws("\u0001", "op", "key", F.coalesce("value", F.lit("")), F.coalesce(F.col("expires_at").cast("string"), F.lit("")))
    return log.select("seq", "ord", payload.alias("payload"), F.crc32(payload).alias("crc"))


def replay(records: DataFrame) -> DataFrame:
    """seq, op, key, value of the records before the first whose checksum is wrong."""
    bad = records.where(F.crc32("payload") != F.col("crc")).agg(F.min(F.struct("seq", "ord")).alias("bad"))  # one row
    part = F.split("payload", "\u0001")
    good = records.join(F.broadcast(bad)).where(F.col("bad").isNull() | (F.struct("seq", "ord") < F.col("bad")))
    return good.select("seq", part[0].alias("op"), part[1].alias("key"), F.when(part[0] == "P", part[2]).alias("value"))


def compact(log: DataFrame, as_of: int, drop_deletes: bool = True, keep: Column | None = None, value: Column | None = None) -> DataFrame:
    """The newest version of each key only, as a log; with ``drop_deletes`` (deepest level) dead keys go too.

    A compaction filter: puts for which ``keep`` does not hold go, and values are replaced by ``value``; both are
    expressions of key and value.
    """
    out = latest(log)
    out = out.where(is_live(as_of)) if drop_deletes else out
    if keep is not None:
        out = out.where((F.col("op") == "D") | keep)
    if value is not None:
        out = out.withColumn("value", F.when(F.col("op") == "P", value))
    return out.select("seq", F.lit(0).alias("ord"), "key", "op", "value", "expires_at")
