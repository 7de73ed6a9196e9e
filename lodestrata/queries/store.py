"""Every method of a store, on the store itself, on a snapshot, in a transaction's reads, and in a namespace.

One table of methods holds the call and its SQL; a world says which change log it runs on and how its keys are written.
SQL of a write gives its batch; the twin shows the whole store after it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.inputs import AS_OF, DAY, cents, events, latest_sql, live_sql, table
from lodestrata.plans import log as kv
from lodestrata.registry import add
from lodestrata.store import Namespace, Store


def number(column: str = "user_id") -> Column:
    return F.lpad(F.col(column).cast("string"), 6, "0")


def mixed_log(s: SparkSession, d: str) -> DataFrame:
    """The change log of two kinds of keys; values are whole numbers (cents)."""
    kind = F.col("event_type")
    key = F.concat(F.when(F.col("user_id") % 3 == 0, "sess:").otherwise("user:"), number())
    return events(s, d).select(
        F.col("event_id").alias("seq"), F.lit(0).alias("ord"), key.alias("key"), F.when(kind == "error", "D").otherwise("P").alias("op"),
        F.when(kind != "error", cents().cast("string")).alias("value"), F.when(kind == "signup", F.col("ts_us") + 7 * DAY).alias("expires_at"),
    )


MIXED_SQL = f"""log0 AS (SELECT event_id AS seq, CASE WHEN user_id % 3 = 0 THEN 'sess:' ELSE 'user:' END || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, CASE WHEN event_type = 'error' THEN 'D' ELSE 'P' END AS op,
 CASE WHEN event_type <> 'error' THEN CAST(CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) AS VARCHAR) END AS value, CASE WHEN event_type = 'signup' THEN epoch_us(ts) + {7 * DAY} END AS expires_at FROM events)"""


@dataclass(frozen=True)
class World:
    """A store to run methods on: ``prefix`` of its keys as they are asked for, the log as SQL, and the rest of the store."""

    prefix: str
    store: Callable[[SparkSession, str], Store]
    log_sql: str
    rest_sql: str
    cut: str = ""  # prefix that the store's keys have beyond the asked ones

    def sql(self, body: str, writes: bool) -> str:
        asked = f"p AS (SELECT '{self.prefix}' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS key, * FROM customer)"
        head = f"WITH {MIXED_SQL}, {self.log_sql}, {latest_sql()}, {live_sql()}, {live_sql('seq <= 9000', 'early')}, {asked}"
        body = body.replace("~", self.prefix)
        if not writes:
            return f"{head} {body}"
        return f"""{head}, b AS ({body}), after AS (SELECT key, value, expires_at FROM live WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT key, value, expires_at FROM b WHERE op = 'P' AND (expires_at IS NULL OR expires_at > {AS_OF}))
 SELECT '{self.cut}' || key AS key, value, expires_at FROM after UNION ALL {self.rest_sql}"""


WORLDS = {
    "kv": World("user:", lambda s, d: Store(mixed_log(s, d), AS_OF), "log AS (SELECT * FROM log0)", "SELECT key, value, expires_at FROM live WHERE false"),
    "snap": World("user:", lambda s, d: Store(mixed_log(s, d), AS_OF).snapshot(5000), "log AS (SELECT * FROM log0 WHERE seq <= 5000)", ""),
    "txn": World("user:", lambda s, d: Store(mixed_log(s, d), AS_OF).snapshot(9000), "log AS (SELECT * FROM log0 WHERE seq <= 9000)", ""),
    "ns": World("", lambda s, d: Namespace(Store(mixed_log(s, d), AS_OF), "user"), "log AS (SELECT seq, substr(key, 6) AS key, op, value, expires_at FROM log0 WHERE starts_with(key, 'user:'))", "SELECT key, value, expires_at FROM full_ WHERE NOT starts_with(key, 'user:')", "user:"),
}
WORLDS["ns"] = World(WORLDS["ns"].prefix, WORLDS["ns"].store, f"{live_sql('true', 'full_', 'log0')}, {WORLDS['ns'].log_sql}", WORLDS["ns"].rest_sql, "user:")


class Asked:
    """Requests for a world's keys: all customers, or those of a market segment."""

    def __init__(self, s: SparkSession, d: str, prefix: str) -> None:
        self.prefix = prefix
        self.rows = table(s, d, "customer").withColumn("key", F.concat(F.lit(prefix), number("c_custkey")))

    def keys(self, segment: str | None = None) -> DataFrame:
        return (self.rows if segment is None else self.rows.where(F.col("c_mktsegment") == segment)).select("key")

    def values(self) -> DataFrame:
        return self.rows.select("key", F.col("c_name").alias("value"))

    def names(self, other: str) -> DataFrame:
        return self.rows.select("key", F.concat(F.lit(f"{self.prefix}{other}"), number("c_custkey")).alias("new_key"))

    def pairs(self) -> DataFrame:
        odd = self.rows.select((F.col("c_custkey") - (F.col("c_custkey") + 1) % 2).alias("n")).distinct().withColumn("m", F.col("n") + 1)
        return odd.select(*[F.concat(F.lit(self.prefix), number(x)).alias(y) for x, y in (("n", "a"), ("m", "b"))])

    def amounts(self, exact: bool) -> DataFrame:
        return self.rows.select("key", (cents("c_acctbal") if exact else F.col("c_acctbal")).alias("amount"))

    def times(self) -> DataFrame:
        return self.rows.select("key", (F.lit(AS_OF - DAY) + F.col("c_custkey") * (DAY // 100)).alias("at_us"))

    def swaps(self, store: Store) -> DataFrame:
        seen = store.snapshot(9000).live.select("key", F.col("value").alias("seen"))
        segment = F.col("c_mktsegment")
        held = self.rows.join(seen, "key", "left")
        return held.select("key", F.when(segment != "BUILDING", F.col("seen")).alias("expected"), F.when(segment != "FURNITURE", F.col("c_name")).alias("new"))


def _long() -> Column:
    """Long values with a nought more; short ones go."""
    return F.when(F.length("value") > 4, F.concat("value", F.lit("0")))


_LONG_SQL = "CASE WHEN length(value) > 4 THEN value || '0' END"


def _put(value: str, source: str, expires: str = "NULL") -> str:
    return f"SELECT key, 'P' AS op, CAST({value} AS VARCHAR) AS value, CAST({expires} AS BIGINT) AS expires_at FROM {source}"


def _gone(source: str) -> str:
    return f"SELECT key, 'D' AS op, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS BIGINT) AS expires_at FROM {source}"


def _joined(how: str, kind: str, amount: str) -> str:
    held = f"CAST(nullif(live.value, '') AS {kind})"
    new = {"sum": f"coalesce({held}, CAST(0 AS {kind})) + {amount}", "max": f"greatest({held}, {amount})", "min": f"least({held}, {amount})"}[how]
    return f"SELECT p.key, 'P' AS op, CAST({new} AS VARCHAR) AS value, CAST(NULL AS BIGINT) AS expires_at FROM p LEFT JOIN live ON live.key = p.key"


_CENTS = "CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 100 AS BIGINT)"
_OLD = "SELECT p.key, live.value FROM p LEFT JOIN live ON live.key = p.key"
_COPY = "SELECT '~copy:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS key, 'P' AS op, live.value, CAST(NULL AS BIGINT) AS expires_at FROM p JOIN live ON live.key = p.key"
_MOVE = _COPY + " UNION ALL SELECT p.key, 'D', NULL, NULL FROM p JOIN live ON live.key = p.key"
_SWAP = """SELECT unnest([{'k': x.key, 'v': y.value}, {'k': y.key, 'v': x.value}]) AS u FROM (SELECT DISTINCT '~' || lpad(CAST(c_custkey - (c_custkey + 1) % 2 AS VARCHAR), 6, '0') AS a, '~' || lpad(CAST(c_custkey - (c_custkey + 1) % 2 + 1 AS VARCHAR), 6, '0') AS b FROM customer) n JOIN live x ON x.key = n.a JOIN live y ON y.key = n.b"""
_CAS = "SELECT p.key, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'D' ELSE 'P' END AS op, CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_name END AS value, CAST(NULL AS BIGINT) AS expires_at FROM p LEFT JOIN early ON early.key = p.key LEFT JOIN live ON live.key = p.key WHERE live.value IS NOT DISTINCT FROM CASE WHEN c_mktsegment <> 'BUILDING' THEN early.value END"
_IN = "live WHERE key IN (SELECT key FROM p WHERE c_mktsegment = 'AUTOMOBILE')"

#: Reads: name -> (call of (store, requests), SQL).  ``~`` stands for the prefix of a world's keys.
READS: dict[str, tuple[Callable[[Store, Asked], DataFrame], str]] = {
    "get": (lambda x, a: x.get(f"{a.prefix}000016"), "SELECT key, value FROM live WHERE key = '~000016'"),
    "has": (lambda x, a: x.has(f"{a.prefix}000016"), "SELECT count(*) > 0 AS found FROM live WHERE key = '~000016'"),
    "get_many": (lambda x, a: x.get_many(a.keys()), _OLD),
    "mget": (lambda x, a: x.mget(a.keys("MACHINERY")), _OLD + " WHERE c_mktsegment = 'MACHINERY'"),
    "exists_many": (lambda x, a: x.exists_many(a.keys()), "SELECT p.key, live.key IS NOT NULL AS found FROM p LEFT JOIN live ON live.key = p.key"),
    "scan": (lambda x, a: x.scan(f"{a.prefix}000010", f"{a.prefix}000100", 50), "SELECT key, value FROM live WHERE key >= '~000010' AND key < '~000100' ORDER BY key LIMIT 50"),
    "items": (lambda x, a: x.items(None, f"{a.prefix}000050"), "SELECT key, value FROM live WHERE key < '~000050'"),
    "scan_keys": (lambda x, a: x.scan_keys(f"{a.prefix}000010", None, 25), "SELECT key FROM live WHERE key >= '~000010' ORDER BY key LIMIT 25"),
    "keys": (lambda x, a: x.keys(), "SELECT key FROM live"),
    "values": (lambda x, a: x.values(f"{a.prefix}000010"), "SELECT value FROM live WHERE key >= '~000010'"),
    "prefix_scan": (lambda x, a: x.prefix_scan(f"{a.prefix}0000"), "SELECT key, value FROM live WHERE starts_with(key, '~0000')"),
    "count": (lambda x, a: x.count(f"{a.prefix}000010", ""), "SELECT count(*) AS n FROM live WHERE key >= '~000010'"),
    "count_prefix": (lambda x, a: x.count_prefix(f"{a.prefix}00001"), "SELECT count(*) AS n FROM live WHERE starts_with(key, '~00001')"),
    "is_empty": (lambda x, a: x.is_empty(f"{a.prefix}000010"), "SELECT count(*) = 0 AS is_empty FROM live WHERE key >= '~000010'"),
    "first": (lambda x, a: x.first(f"{a.prefix}000011"), "SELECT key, value FROM live WHERE key >= '~000011' ORDER BY key LIMIT 1"),
    "last": (lambda x, a: x.last(None, f"{a.prefix}000111"), "SELECT key, value FROM live WHERE key < '~000111' ORDER BY key DESC LIMIT 1"),
    "tail": (lambda x, a: x.tail(9), "SELECT key, value FROM live ORDER BY key DESC LIMIT 9"),
    "scan_filter": (lambda x, a: x.scan_filter(F.length("value") > 4, f"{a.prefix}000005", None, 40), "SELECT key, value FROM live WHERE length(value) > 4 AND key >= '~000005' ORDER BY key LIMIT 40"),
    "grep": (lambda x, a: x.grep("^.*[02468]$", None, None, 30), "SELECT key FROM live WHERE regexp_matches(key, '^.*[02468]$') ORDER BY key LIMIT 30"),
    "ttl_remaining": (lambda x, a: x.ttl_remaining(a.keys()), f"SELECT p.key, latest.expires_at - {AS_OF} AS left_us FROM p LEFT JOIN latest ON latest.key = p.key AND latest.op = 'P'"),
    "key_type": (lambda x, a: x.key_type(a.keys()), f"SELECT p.key, CASE WHEN latest.key IS NULL OR op <> 'P' THEN 'none' WHEN expires_at IS NULL OR expires_at > {AS_OF} THEN 'string' ELSE 'expired' END AS kind FROM p LEFT JOIN latest ON latest.key = p.key"),
    "getset": (lambda x, a: x.getset(a.values())[0], _OLD),
    "getdel": (lambda x, a: x.getdel(a.keys())[0], _OLD),
    "pop": (lambda x, a: x.pop(a.keys(), "none")[0], "SELECT p.key, coalesce(live.value, 'none') AS value FROM p LEFT JOIN live ON live.key = p.key"),
    "get_or_compute_once": (lambda x, a: x.get_or_compute(a.keys().union(a.keys()), F.sha2("key", 256))[0], "SELECT p.key, coalesce(live.value, sha256(p.key)) AS value FROM p LEFT JOIN live ON live.key = p.key, (SELECT unnest([1, 2])) AS twice"),
    "delete_many_count": (lambda x, a: x.delete_many(a.keys()).agg(F.count(F.lit(1)).alias("submitted")), "SELECT count(*) AS submitted FROM p"),
    "range_delete_count": (lambda x, a: x.range_delete(f"{a.prefix}000020", f"{a.prefix}000090").agg(F.count(F.lit(1)).alias("deleted")), "SELECT count(*) AS deleted FROM live WHERE key >= '~000020' AND key < '~000090'"),
    "prefix_delete_count": (lambda x, a: x.prefix_delete(f"{a.prefix}00001").agg(F.count(F.lit(1)).alias("deleted")), "SELECT count(*) AS deleted FROM live WHERE starts_with(key, '~00001')"),
    "clear_count": (lambda x, a: x.clear().agg(F.count(F.lit(1)).alias("deleted")), "SELECT count(*) AS deleted FROM live"),
    "touch_many_count": (lambda x, a: x.touch_many(a.keys(), DAY).agg(F.count(F.lit(1)).alias("touched")), "SELECT count(*) AS touched FROM live WHERE key IN (SELECT key FROM p)"),
    "map_values_count": (lambda x, a: x.map_values(_long()).agg(F.count(F.lit(1)).alias("changed")), f"SELECT count(*) AS changed FROM live WHERE value IS DISTINCT FROM {_LONG_SQL}"),
}

#: Writes: name -> (call that gives a batch, SQL of the batch).
WRITES: dict[str, tuple[Callable[[Store, Asked], DataFrame], str]] = {
    "put": (lambda x, a: x.put(a.values()), _put("c_name", "p")),
    "mset": (lambda x, a: x.mset(a.values(), DAY), _put("c_name", "p", str(AS_OF + DAY))),
    "put_ttl": (lambda x, a: x.put_ttl(a.values(), -1), _put("c_name", "p", str(AS_OF - 1))),
    "delete": (lambda x, a: x.delete(a.keys("BUILDING")), _gone("p WHERE c_mktsegment = 'BUILDING'")),
    "delete_many": (lambda x, a: x.delete_many(a.keys("HOUSEHOLD")), _gone("p WHERE c_mktsegment = 'HOUSEHOLD'")),
    "mdel": (lambda x, a: x.mdel(a.keys()), _gone("p")),
    "clear": (lambda x, a: x.clear(a.prefix), _gone("live WHERE starts_with(key, '~')")),
    "prefix_delete": (lambda x, a: x.prefix_delete(f"{a.prefix}0000"), _gone("live WHERE starts_with(key, '~0000')")),
    "delete_prefix": (lambda x, a: x.delete_prefix(f"{a.prefix}00001"), _gone("live WHERE starts_with(key, '~00001')")),
    "range_delete": (lambda x, a: x.range_delete(f"{a.prefix}000020"), _gone("live WHERE key >= '~000020'")),
    "expire": (lambda x, a: x.expire(a.keys("AUTOMOBILE"), DAY), _put("value", _IN, str(AS_OF + DAY))),
    "touch": (lambda x, a: x.touch(a.keys("AUTOMOBILE"), 0), _put("value", _IN)),
    "touch_many": (lambda x, a: x.touch_many(a.keys("AUTOMOBILE"), -1), _put("value", _IN, str(AS_OF - 1))),
    "expireat": (lambda x, a: x.expireat(a.times()), f"SELECT p.key, 'P' AS op, live.value, greatest({AS_OF - DAY} + c_custkey * {DAY // 100}, {AS_OF + 1000}) AS expires_at FROM p JOIN live ON live.key = p.key"),
    "compare_and_swap": (lambda x, a: x.compare_and_swap(a.swaps(x)), _CAS),
    "update": (lambda x, a: x.update(_long(), DAY), f"SELECT key, CASE WHEN {_LONG_SQL} IS NULL THEN 'D' ELSE 'P' END AS op, {_LONG_SQL} AS value, CAST({AS_OF + DAY} AS BIGINT) AS expires_at FROM live"),
    "map_values": (lambda x, a: x.map_values(F.regexp_replace("value", "^1", "9"), f"{a.prefix}000050"), _put("regexp_replace(value, '^1', '9')", "live WHERE key >= '~000050' AND regexp_matches(value, '^1')")),
    "set_if_absent": (lambda x, a: x.set_if_absent(a.values(), DAY), _put("c_name", "p WHERE key NOT IN (SELECT key FROM live)", str(AS_OF + DAY))),
    "set_if_present": (lambda x, a: x.set_if_present(a.values()), _put("c_name", "p WHERE key IN (SELECT key FROM live)")),
    "setdefault": (lambda x, a: x.get_or_compute(a.keys(), F.lit("none"))[1], _put("'none'", "p WHERE key NOT IN (SELECT key FROM live)")),
    "copy": (lambda x, a: x.copy(a.names("copy:")), _COPY),
    "rename": (lambda x, a: x.rename(a.names("copy:")), _MOVE),
    "rename_many": (lambda x, a: x.rename_many(a.names("copy:")), _MOVE),
    "swap": (lambda x, a: x.swap(a.pairs()), f"SELECT u.k AS key, 'P' AS op, u.v AS value, CAST(NULL AS BIGINT) AS expires_at FROM ({_SWAP})"),
    "increment": (lambda x, a: x.increment(a.amounts(True)), _joined("sum", "BIGINT", _CENTS)),
    "atomic_max": (lambda x, a: x.atomic_max(a.amounts(True)), _joined("max", "BIGINT", _CENTS)),
    "atomic_min": (lambda x, a: x.atomic_min(a.amounts(True)), _joined("min", "BIGINT", _CENTS)),
    "increment_float": (lambda x, a: x.increment_float(a.amounts(False)), _joined("sum", "DOUBLE", "c_acctbal")),
    "atomic_max_float": (lambda x, a: x.atomic_max_float(a.amounts(False)), _joined("max", "DOUBLE", "c_acctbal")),
    "atomic_min_float": (lambda x, a: x.atomic_min_float(a.amounts(False)), _joined("min", "DOUBLE", "c_acctbal")),
}

_SNAPSHOT = "get scan scan_keys has get_many count count_prefix is_empty first last scan_filter grep tail prefix_scan".split()
_TXN = "get has get_many scan scan_keys".split()
_KV = "get has pop get_or_compute_once delete_many_count range_delete_count prefix_delete_count clear_count touch_many_count map_values_count".split()
_KV_WRITES = "put put_ttl mset clear expire touch touch_many expireat update setdefault set_if_absent set_if_present compare_and_swap increment increment_float atomic_max_float atomic_min_float".split()


def _register(world: str, name: str, call: Callable[[Store, Asked], DataFrame], sql: str, writes: bool) -> None:
    w = WORLDS[world]

    def run(s: SparkSession, d: str) -> DataFrame:
        store = w.store(s, d)
        out = call(store, Asked(s, d, w.prefix))
        return store.state(out) if writes else out

    add(f"{world}_{name}", run, w.sql(sql, writes))


for _name, (_call, _sql) in READS.items():
    for _world, _some in (("snap", _SNAPSHOT), ("txn", _TXN), ("ns", list(READS))):
        if _name in _some:
            _register(_world, _name, _call, _sql, False)
    if _name in _KV:
        _register("kv", f"store_{_name}", _call, _sql, False)
for _name, (_call, _sql) in WRITES.items():
    _register("ns", _name, _call, _sql, True)
    if _name in _KV_WRITES:
        _register("kv", f"store_{_name}", _call, _sql, True)


# --- write batches and pipelines --------------------------------------------------------------------------------------------
def _batches(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Puts with a time to live of all customers, then one batch of plain puts and deletes of all suppliers' numbers."""
    store = Store(mixed_log(s, d), AS_OF)
    asked = Asked(s, d, "user:")
    first = store.put_ttl(asked.values(), DAY).withColumn("ord", F.regexp_extract("key", r"\d+", 0).cast("int"))
    supplier = table(s, d, "supplier").select(F.concat(F.lit("user:"), number("s_suppkey")).alias("key"), F.col("s_name").alias("value"), "s_acctbal", F.col("s_suppkey").cast("int").alias("ord"))
    good, bad = supplier.where("s_acctbal >= 5000"), supplier.where("s_acctbal < 5000")
    rest = store.put(good).drop("ord").join(good.select("key", "ord"), "key").unionByName(store.delete(bad).drop("ord").join(bad.select("key", "ord"), "key"))
    return first.select("ord", "key", "op", "value", "expires_at"), rest.select("ord", "key", "op", "value", "expires_at")


_FIRST = f"b1 AS (SELECT CAST(c_custkey AS INT) AS ord, 'user:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS key, 'P' AS op, c_name AS value, CAST({AS_OF + DAY} AS BIGINT) AS expires_at FROM customer)"
_SECOND = "b2 AS (SELECT CAST(s_suppkey AS INT) AS ord, 'user:' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS key, CASE WHEN s_acctbal >= 5000 THEN 'P' ELSE 'D' END AS op, CASE WHEN s_acctbal >= 5000 THEN s_name END AS value, CAST(NULL AS BIGINT) AS expires_at FROM supplier)"
_BOTH = f"WITH {_FIRST}, {_SECOND}, b AS (SELECT * FROM b1 UNION ALL SELECT ord + (SELECT max(ord) + 1 FROM b1), key, op, value, expires_at FROM b2)"
_COUNTS = "CAST(count(*) FILTER (op = 'P') AS BIGINT) AS puts, CAST(count(*) FILTER (op = 'D') AS BIGINT) AS deletes, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes"
add("wb_merge", lambda s, d: kv.merge_batches(*_batches(s, d)), _BOTH + " SELECT * FROM b")
add("wb_ops", lambda s, d: _batches(s, d)[1].orderBy("ord"), f"WITH {_SECOND} SELECT * FROM b2 ORDER BY ord")
add("wb_counts", lambda s, d: kv.batch_counts(_batches(s, d)[1]), f"WITH {_SECOND} SELECT {_COUNTS} FROM b2")
add("pl_counts", lambda s, d: kv.batch_counts(kv.merge_batches(*_batches(s, d))), _BOTH + f" SELECT {_COUNTS} FROM b")
add("pl_execute", lambda s, d: Store(mixed_log(s, d), AS_OF).state(kv.merge_batches(*_batches(s, d))), _BOTH + f", {MIXED_SQL}, {live_sql('true', 'live', 'log0')}, last AS (SELECT key, arg_max({{'op': op, 'value': value, 'expires_at': expires_at}}, ord) AS x FROM b GROUP BY key) SELECT key, value, expires_at FROM live WHERE key NOT IN (SELECT key FROM last) UNION ALL SELECT key, x.value, x.expires_at FROM last WHERE x.op = 'P' AND (x.expires_at IS NULL OR x.expires_at > {AS_OF})")


# --- transactions -------------------------------------------------------------------------------------------------------------
def _transactions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, Store]:
    """A transaction a customer: it reads its own key and writes another one (poor customers delete it)."""
    store = Store(mixed_log(s, d), AS_OF)
    rows = table(s, d, "customer")
    last = rows.agg(F.max("c_custkey").alias("last"))  # one row
    other = F.concat(F.lit("user:"), F.lpad((F.col("c_custkey") * 7919 % F.col("last")).cast("string"), 6, "0"))
    rows = rows.join(F.broadcast(last)).select(F.col("c_custkey").alias("txn"), F.concat(F.lit("user:"), number("c_custkey")).alias("own"), other.alias("other"), "c_name", "c_acctbal")
    seen = store.snapshot(9000).live.select(F.col("key").alias("own"), F.col("value").alias("seen"))
    reads = rows.join(seen, "own", "left").select("txn", F.col("own").alias("key"), "seen")
    poor = F.col("c_acctbal") < 0
    writes = rows.select("txn", F.col("other").alias("key"), F.when(poor, "D").otherwise("P").alias("op"), F.when(~poor, F.col("c_name")).alias("value"))
    return reads, writes, store


def _commits(s: SparkSession, d: str) -> DataFrame:
    from lodestrata.operators import txn

    reads, writes, store = _transactions(s, d)
    return txn.commit(reads, writes, store.live)


def _committed_state(s: SparkSession, d: str) -> DataFrame:
    from lodestrata.operators import txn

    _, writes, store = _transactions(s, d)
    return store.state(txn.committed_writes(writes, _commits(s, d)))


# commits depend on earlier ones in order: tested against brute force
add("txn_commit", _commits, None)
add("txn_apply", _committed_state, None)
add("txn_put", lambda s, d: _transactions(s, d)[1].where("op = 'P'"), "SELECT c_custkey AS txn, 'user:' || lpad(CAST(c_custkey * 7919 % (SELECT max(c_custkey) FROM customer) AS VARCHAR), 6, '0') AS key, 'P' AS op, c_name AS value FROM customer WHERE c_acctbal >= 0")
add("txn_delete", lambda s, d: _transactions(s, d)[1].where("op = 'D'").select("txn", "key"), "SELECT c_custkey AS txn, 'user:' || lpad(CAST(c_custkey * 7919 % (SELECT max(c_custkey) FROM customer) AS VARCHAR), 6, '0') AS key FROM customer WHERE c_acctbal < 0")
