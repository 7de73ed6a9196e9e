"""A change log as an ordered key-value store: reads give rows, writes give batches.

A batch is a DataFrame (ord, key, op, value, expires_at); ``state`` gives the store after it, ``plans.log.append`` the
log with it.  Requests for many keys are DataFrames too, one row a key unless stated otherwise, so each method is one
plan however many keys it touches.  Rewriting a value drops its time to live unless one is given; a time to live of
zero or less makes a key permanent in ``put``, ``touch`` and ``expire``, and expired in ``put_ttl`` and ``touch_many``.
``Namespace`` is the same interface on the keys below a prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import scan as reads
from lodestrata.plans import log as kv

BATCH = ("ord", "key", "op", "value", "expires_at")


def _never() -> Column:
    return F.lit(None).cast("long")


def float_text(x: Column) -> Column:
    """The shortest decimal text of a double, without an exponent from 1e-4 up to 1e16."""
    plain = F.regexp_replace(x.cast("string").cast("decimal(38,18)").cast("string"), r"(\.\d+?)0+$", "$1")
    size = F.abs(x)
    return F.when((size >= 1e-4) & (size < 1e16) & ((size < 1e-3) | (size >= 1e7)), plain).otherwise(x.cast("string"))


class Store:
    """``log`` as it is at ``as_of`` (microseconds)."""

    def __init__(self, log: DataFrame, as_of: int) -> None:
        self.log, self.as_of = log, as_of

    # --- views ------------------------------------------------------------------------------------------------------------
    @property
    def latest(self) -> DataFrame:
        return kv.latest(self.log)

    @property
    def live(self) -> DataFrame:
        return kv.live(self.log, self.as_of)

    def snapshot(self, seq: int) -> Store:
        """The store as of commit ``seq``; expiry is still judged at ``as_of``."""
        return Store(kv.snapshot(self.log, seq), self.as_of)

    def state(self, batch: DataFrame) -> DataFrame:
        """Live keys (key, value, expires_at) after ``batch``."""
        log = self.log.select("seq", *BATCH)
        return kv.live(kv.append(log, batch), self.as_of).select("key", "value", "expires_at")

    def _expires(self, ttl_us: int, kept: bool = True) -> Column:
        """Expiry of a time to live; with ``kept`` zero or less means never."""
        return F.lit(self.as_of + ttl_us).cast("long") if ttl_us > 0 or not kept else _never()

    def _puts(self, rows: DataFrame, expires: Column | None = None) -> DataFrame:
        return rows.select(F.lit(0).alias("ord"), "key", F.lit("P").alias("op"), F.col("value").cast("string").alias("value"), (_never() if expires is None else expires).alias("expires_at"))

    def _deletes(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(0).alias("ord"), "key", F.lit("D").alias("op"), F.lit(None).cast("string").alias("value"), _never().alias("expires_at"))

    def _rewrites(self, rows: DataFrame, expires: Column | None = None) -> DataFrame:
        """Puts; a null value deletes."""
        gone = F.col("value").isNull()
        at = _never() if expires is None else expires
        return rows.select(F.lit(0).alias("ord"), "key", F.when(gone, "D").otherwise("P").alias("op"), F.col("value").cast("string").alias("value"), F.when(~gone, at).alias("expires_at"))

    # --- reads --------------------------------------------------------------------------------------------------------------
    def get(self, key: str) -> DataFrame:
        return kv.live(self.log.where(F.col("key") == key), self.as_of).select("key", "value")

    def has(self, key: str) -> DataFrame:
        return self.get(key).agg((F.count(F.lit(1)) > 0).alias("found"))

    def get_many(self, keys: DataFrame) -> DataFrame:
        return reads.multi_get(keys, self.live)

    mget = get_many

    def exists_many(self, keys: DataFrame) -> DataFrame:
        return keys.join(self.live.select("key", F.lit(True).alias("found")), "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"))

    def scan(self, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
        return reads.scan(self.live, start, end, limit).select("key", "value")

    items = scan

    def scan_keys(self, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
        return self.scan(start, end, limit).select("key")

    keys = scan_keys

    def values(self, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
        return self.scan(start, end, limit).select("value")

    def prefix_scan(self, prefix: str) -> DataFrame:
        return reads.prefix(self.live, prefix).select("key", "value")

    def count(self, start: str | None = None, end: str | None = None) -> DataFrame:
        return kv.between(self.live, start, end).agg(F.count(F.lit(1)).alias("n"))

    def count_prefix(self, prefix: str) -> DataFrame:
        return self.live.where(F.col("key").startswith(prefix)).agg(F.count(F.lit(1)).alias("n"))

    def is_empty(self, start: str | None = None, end: str | None = None) -> DataFrame:
        return reads.is_empty(kv.between(self.live, start, end))

    def first(self, start: str | None = None, end: str | None = None) -> DataFrame:
        return self.scan(start, end, 1)

    def last(self, start: str | None = None, end: str | None = None) -> DataFrame:
        return reads.scan(self.live, start, end, 1, reverse=True).select("key", "value")

    def tail(self, n: int, end: str | None = None) -> DataFrame:
        return reads.tail(self.live, n, None, end).select("key", "value")

    def scan_filter(self, condition: Column, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
        return reads.scan(self.live.where(condition), start, end, limit).select("key", "value")

    def grep(self, pattern: str, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
        """Keys that the regular expression finds."""
        return reads.scan(self.live.where(F.col("key").rlike(pattern)), start, end, limit).select("key")

    def ttl_remaining(self, keys: DataFrame) -> DataFrame:
        """key, left_us: null without a time to live or without the key, negative if expired."""
        held = self.latest.where("op = 'P'").select("key", (F.col("expires_at") - self.as_of).alias("left_us"))
        return keys.join(held, "key", "left").select("key", "left_us")

    def key_type(self, keys: DataFrame) -> DataFrame:
        """key, kind: string, expired or none."""
        return keys.join(reads.key_type(self.latest, self.as_of), "key", "left").select("key", F.coalesce("kind", F.lit("none")).alias("kind"))

    # --- writes ---------------------------------------------------------------------------------------------------------------
    def put(self, rows: DataFrame, ttl_us: int = 0) -> DataFrame:
        return self._puts(rows, self._expires(ttl_us))

    mset = put

    def put_ttl(self, rows: DataFrame, ttl_us: int) -> DataFrame:
        return self._puts(rows, self._expires(ttl_us, kept=False))

    def delete(self, keys: DataFrame) -> DataFrame:
        """Tombstones of all keys named, present or not: as many as were submitted."""
        return self._deletes(keys)

    delete_many = mdel = delete

    def range_delete(self, start: str | None = None, end: str | None = None) -> DataFrame:
        return self._deletes(kv.between(self.live, start, end))

    def prefix_delete(self, prefix: str = "") -> DataFrame:
        return self._deletes(self.live.where(F.col("key").startswith(prefix)))

    delete_prefix = clear = prefix_delete

    def touch(self, keys: DataFrame, ttl_us: int) -> DataFrame:
        return self._puts(self.live.join(keys, "key", "left_semi"), self._expires(ttl_us))

    expire = touch

    def touch_many(self, keys: DataFrame, ttl_us: int) -> DataFrame:
        return self._puts(self.live.join(keys, "key", "left_semi"), self._expires(ttl_us, kept=False))

    def expireat(self, times: DataFrame) -> DataFrame:
        """times(key, at_us); a time in the past is a millisecond from now."""
        return self._puts(self.live.join(times, "key"), F.greatest("at_us", F.lit(self.as_of + 1000)).cast("long"))

    def compare_and_swap(self, swaps: DataFrame) -> DataFrame:
        """swaps(key, expected, new): set where the value equals ``expected`` (null: absent); a null ``new`` deletes."""
        held = swaps.join(self.live.select("key", F.col("value").alias("now")), "key", "left").where(F.col("now").eqNullSafe(F.col("expected")))
        return self._rewrites(held.select("key", F.col("new").alias("value")))

    def update(self, value: Column, ttl_us: int = 0) -> DataFrame:
        """Every live value replaced by ``value`` (of key and value); null deletes."""
        return self._rewrites(self.live.select("key", value.alias("value")), self._expires(ttl_us))

    def map_values(self, value: Column, start: str | None = None, end: str | None = None) -> DataFrame:
        """The values that ``value`` changes; null deletes."""
        rows = kv.between(self.live, start, end).withColumn("now", value).where(~F.col("now").eqNullSafe(F.col("value")))
        return self._rewrites(rows.select("key", F.col("now").alias("value")))

    def set_if_absent(self, rows: DataFrame, ttl_us: int = 0) -> DataFrame:
        return self._puts(rows.join(self.live.select("key"), "key", "left_anti"), self._expires(ttl_us))

    def set_if_present(self, rows: DataFrame, ttl_us: int = 0) -> DataFrame:
        return self._puts(rows.join(self.live.select("key"), "key", "left_semi"), self._expires(ttl_us))

    def getset(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What the keys of rows(key, value) held, and the batch."""
        return reads.multi_get(rows.select("key"), self.live), self._puts(rows)

    def getdel(self, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What the keys held, and the batch: present keys only."""
        held = self.live.join(keys, "key", "left_semi")
        return reads.multi_get(keys, self.live), self._deletes(held)

    def pop(self, keys: DataFrame, default: str) -> tuple[DataFrame, DataFrame]:
        found, batch = self.getdel(keys)
        return found.select("key", F.coalesce("value", F.lit(default)).alias("value")), batch

    def get_or_compute(self, keys: DataFrame, value: Column) -> tuple[DataFrame, DataFrame]:
        """The keys' values, computed where absent (``value`` of key) but once a distinct key, and the batch of those."""
        asked = keys.select("key").distinct()
        fresh = asked.join(self.live.select("key"), "key", "left_anti").select("key", value.alias("value"))
        found = self.live.join(asked, "key", "left_semi").select("key", "value").unionByName(fresh)
        return keys.join(found, "key"), self._puts(fresh)

    def copy(self, names: DataFrame, ttl_us: int = 0) -> DataFrame:
        """names(key, new_key)."""
        return self._puts(self.live.join(names, "key").select(F.col("new_key").alias("key"), "value"), self._expires(ttl_us))

    def rename(self, names: DataFrame) -> DataFrame:
        """names(key, new_key): all values are read before any is written; a key that is also a target stays."""
        moved = self.live.join(names, "key")
        gone = moved.select("key").join(moved.select(F.col("new_key").alias("key")), "key", "left_anti")
        return self._puts(moved.select(F.col("new_key").alias("key"), "value")).unionByName(self._deletes(gone))

    rename_many = rename

    def swap(self, pairs: DataFrame) -> DataFrame:
        """pairs(a, b): values of keys that are both present."""
        held = self.live.select("key", "value")
        both = pairs.join(held.toDF("a", "va"), "a").join(held.toDF("b", "vb"), "b")
        two = F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("vb").alias("value")), F.struct(F.col("b").alias("key"), F.col("va").alias("value"))))
        return self._puts(both.select(two.alias("x")).select("x.*"))

    def _combined(self, rows: DataFrame, kind: str, how: str, text) -> DataFrame:
        """Values of rows(key, amount), any number a key, combined with what the keys hold (absent or empty: nothing)."""
        held = F.nullif(F.col("value"), F.lit("")).cast(kind)
        asked = rows.groupBy("key").agg(getattr(F, how)(F.col("amount").cast(kind)).alias("amount"))
        now = asked.join(self.live.select("key", held.alias("held")), "key", "left")
        joint = {"sum": F.coalesce("held", F.lit(0).cast(kind)) + F.col("amount"), "max": F.greatest("held", "amount"), "min": F.least("held", "amount")}[how]
        return self._puts(now.select("key", text(joint).alias("value")))

    def increment(self, rows: DataFrame) -> DataFrame:
        return self._combined(rows, "long", "sum", lambda x: x.cast("string"))

    def atomic_max(self, rows: DataFrame) -> DataFrame:
        return self._combined(rows, "long", "max", lambda x: x.cast("string"))

    def atomic_min(self, rows: DataFrame) -> DataFrame:
        return self._combined(rows, "long", "min", lambda x: x.cast("string"))

    def increment_float(self, rows: DataFrame) -> DataFrame:
        return self._combined(rows, "double", "sum", float_text)

    def atomic_max_float(self, rows: DataFrame) -> DataFrame:
        return self._combined(rows, "double", "max", float_text)

    def atomic_min_float(self, rows: DataFrame) -> DataFrame:
        return self._combined(rows, "double", "min", float_text)

    # --- JSON lines -----------------------------------------------------------------------------------------------------------
    def export(self, path: str, start: str | None = None, end: str | None = None, form: str = "jsonl") -> int:
        """Writes live keys as JSON lines ``{"k", "v"}`` in key order; returns how many."""
        from lodestrata.sources import jsonl

        return jsonl.write(kv.between(self.live, start, end), path, form)


class Namespace(Store):
    """The keys of ``store`` that start with ``prefix`` (which ends with one ``:`` unless empty), without it.

    Everything stays within the prefix, open ends included; batches name local keys, ``mapped`` gives the store's.
    """

    def __init__(self, store: Store, prefix: str) -> None:
        self.store = store
        self.prefix = f"{prefix.rstrip(':')}:" if prefix else ""
        inside = store.log.where(F.col("key").startswith(self.prefix))
        super().__init__(inside.withColumn("key", F.expr(f"substring(key, {len(self.prefix) + 1})")), store.as_of)

    def mapped(self, batch: DataFrame) -> DataFrame:
        return batch.withColumn("key", F.concat(F.lit(self.prefix), "key"))

    def state(self, batch: DataFrame) -> DataFrame:
        """The whole store after a batch of local keys."""
        return self.store.state(self.mapped(batch))
