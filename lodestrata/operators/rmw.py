"""Read-modify-write as set operations: associative ones are windows and aggregates, the others ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.plans import ranged
from lodestrata.plans.folds import fold


def getset(log: DataFrame) -> DataFrame:
    """What each write found: the value before it (null if absent or deleted); one operation a commit and key."""
    return ranged.lagged(log.select("seq", "key", "value"), ["key"], "seq", "old_value", "value").select("seq", "key", "old_value")


def getdel(log: DataFrame) -> DataFrame:
    """What each delete removed."""
    return ranged.lagged(log.select("seq", "key", "op", "value"), ["key"], "seq", "old_value", "value").where("op = 'D'").select("seq", "key", "old_value")


def conditional(ops: DataFrame) -> DataFrame:
    """Whether each of ops(key, seq, mode, value, expires_at, ts_us) applies, in order: modes are P (put), NX (put if
    absent), XX (put if present) and D (delete).  A refused put changes nothing; expiry is judged at each operation.
    """

    def step(state, mode, value, expires, now):
        present = state is not None and (state[1] is None or state[1] > now)
        applied = mode in ("P", "D") or present == (mode == "XX")
        if applied:
            state = None if mode == "D" else (value, expires)
        return state, (applied, value if applied and mode != "D" else state[0] if present and mode != "D" else None)

    return fold(ops, "key", ("seq",), ("mode", "value", "expires_at", "ts_us"), lambda: None, step, every="applied boolean, state string")


def running(log: DataFrame, amount: Column, how: str) -> DataFrame:
    """State after every operation of a counter (sum), a running maximum or minimum."""
    return ranged.running(log.select("seq", "key", amount.alias("amount")), ["key"], "seq", "state", how, F.col("amount")).select("seq", "key", "state")


def appended(log: DataFrame, separator: str = ",", span: int = 1 << 16) -> DataFrame:
    """All puts of a key joined in order: first within spans of ``seq``, so that no task lists a hot key's rows."""
    rows = F.sort_array(F.collect_list(F.struct("seq", "ord", "value")))
    part = log.where("op = 'P'").groupBy("key", F.floor(F.col("seq") / span).alias("span")).agg(rows.alias("r")).select("key", "span", F.array_join("r.value", separator).alias("piece"))
    whole = part.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("span", "piece"))).alias("r"))
    return whole.select("key", F.array_join("r.piece", separator).alias("value"))


def cas_fold(ops: DataFrame) -> DataFrame:
    """Compare-and-swap over ops(seq, key, expected, value): final value and number of swaps that applied.

    A swap applies if the state equals ``expected`` (null: absent).
    """

    def step(state, expected, value):
        return ((value, state[1] + 1) if state[0] == expected else state), ()

    return fold(ops, "key", ("seq",), ("expected", "value"), lambda: (None, 0), step, last="value string, swaps bigint", finish=lambda state: state)


def lock_fold(requests: DataFrame, ttl_us: int, extend_us: int) -> DataFrame:
    """Locks after requests(name, seq, action, owner, ts_us) in order: the last holder, its expiry, and what was granted.

    ``lock`` is granted if nobody holds the lock (or it has expired), ``unlock`` and ``extend`` to the holder only.
    """

    def step(state, action, owner, now):
        holder, until, locks, unlocks, extends = state
        held = holder is not None and until > now
        if action == "lock" and not held:
            return (owner, now + ttl_us, locks + 1, unlocks, extends), ()
        if action == "unlock" and held and holder == owner:
            return (None, None, locks, unlocks + 1, extends), ()
        if action == "extend" and held and holder == owner:
            return (holder, now + extend_us, locks, unlocks, extends + 1), ()
        return state, ()

    return fold(requests, "name", ("seq",), ("action", "owner", "ts_us"), lambda: (None, None, 0, 0, 0), step, last="owner bigint, until_us bigint, locks bigint, unlocks bigint, extends bigint", finish=lambda state: state)


def rate_limit(hits: DataFrame, most: int, window_us: int) -> DataFrame:
    """Fixed windows: hits(key, seq, ts_us) beyond ``most`` in a window are refused."""
    slot = F.floor(F.col("ts_us") / window_us).cast("long")
    place = F.row_number().over(Window.partitionBy("key", "slot").orderBy("seq"))
    return hits.withColumn("slot", slot).withColumn("n", place).select("seq", "key", "slot", (F.col("n") <= most).alias("allowed"))


def map_values(live: DataFrame, value: Column) -> DataFrame:
    """Rows whose value changes, with the new value."""
    return live.withColumn("new_value", value).where(~F.col("value").eqNullSafe(F.col("new_value"))).select("key", F.col("new_value").alias("value"))


def delete_where(live: DataFrame, condition: Column) -> DataFrame:
    """What is left; ``prefix_delete``, ``range_delete`` and ``delete_many`` are conditions."""
    return live.where(~condition).select("key", "value")
