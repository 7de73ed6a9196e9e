"""Optimistic transactions: validated reads, writes applied in the order of the transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.plans.scratch import Tables


def validate(reads: DataFrame, live: DataFrame) -> DataFrame:
    """Reads reads(txn, key, seen) against the store: a transaction conflicts if any value differs."""
    now = reads.join(live.select("key", "value"), "key", "left")
    return now.groupBy("txn").agg(F.count(F.lit(1)).alias("reads"), F.sum(F.when(F.col("seen").eqNullSafe(F.col("value")), 0).otherwise(1)).alias("conflicts")).withColumn("commits", F.col("conflicts") == 0)


def commit(reads: DataFrame, writes: DataFrame, live: DataFrame) -> DataFrame:
    """txn, commits: transactions commit one after the other, in the order of ``txn``.

    One commits if each of its reads(txn, key, seen) still has the value it saw, after the writes(txn, key, op, value)
    of all earlier transactions that committed (none of its own are read).  In a round every transaction is decided
    whose earlier writers are: as many rounds as the longest chain of transactions that wait for one another.  Rounds
    are written, and each is one window along the transactions of a key.
    """
    tables = Tables(reads.sparkSession, "txn")
    base = live.select("key", F.col("value").alias("value0"))
    asked = reads.distinct().join(base, "key", "left").select("txn", "key", F.lit(False).alias("writes"), "seen", "value0", F.lit(None).cast("string").alias("op"), F.lit(None).cast("string").alias("value"))
    made = writes.select("txn", "key", F.lit(True).alias("writes"), F.lit(None).cast("string").alias("seen"), F.lit(None).cast("string").alias("value0"), "op", "value")
    steps = tables.keep(asked.unionByName(made), "steps")
    state = tables.keep(reads.select("txn").union(writes.select("txn")).distinct().withColumn("commits", F.lit(None).cast("boolean")), "state0")
    before = Window.partitionBy("key").orderBy("txn").rangeBetween(Window.unboundedPreceding, -1)
    done, n = -1, 0
    while True:
        known = steps.join(state, "txn")
        waits = F.max((F.col("writes") & F.col("commits").isNull()).cast("int")).over(before) == 1
        newest = F.last(F.when(F.col("writes") & F.col("commits"), F.struct("op", "value")), ignorenulls=True).over(before)
        seen = known.withColumns({"waits": F.coalesce(waits, F.lit(False)), "newest": newest}).where("not writes and commits is null")
        now = F.when(F.col("newest").isNull(), F.col("value0")).when(F.col("newest.op") == "P", F.col("newest.value"))
        judged = seen.groupBy("txn").agg(F.max("waits").alias("waits"), F.min(F.col("seen").eqNullSafe(now)).alias("same"))
        fresh = state.join(judged, "txn", "left")
        decided = F.when(F.col("commits").isNotNull(), F.col("commits")).when(F.col("same").isNull(), F.lit(True)).when(~F.col("waits"), F.col("same"))
        n += 1
        state = tables.keep(fresh.select("txn", decided.alias("commits")), f"state{n}")
        left, count = state.agg(F.count_if(F.col("commits").isNull()), F.count(F.lit(1))).first()
        if not left:
            return state
        if count - left == done:
            raise RuntimeError("transactions wait for one another")
        done = count - left


def committed_writes(writes: DataFrame, decided: DataFrame) -> DataFrame:
    """The writes of committed transactions as one batch, ordered by transaction."""
    return writes.join(decided.where("commits").select("txn"), "txn").select(F.col("txn").cast("int").alias("ord"), "key", "op", "value", F.lit(None).cast("long").alias("expires_at"))
