"""All queries of the key-value engine and its structures over the driver's tables, with their SQL twins.

``QUERIES`` maps a name to (function of (spark, sf_dir), SQL or None).
"""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import metrics, sketch
from lodestrata.inputs import AS_OF, CENTS_SQL, DAY, FROM, KV, LAG, LOG_SQL, cents, events, kv_log, latest_sql, live, live_sql, pair, table, user
from lodestrata.operators import graph, rmw, scan, text, txn
from lodestrata.operators import structures as st
from lodestrata.plans import log as kv
from lodestrata.registry import QUERIES, Query, add, query
from lodestrata.store import Store

# --- reads ------------------------------------------------------------------------------------------------------------
add("kv_live", lambda s, d: live(s, d).select("key", "value", "expires_at", "seq"), KV + "SELECT key, value, expires_at, seq FROM live")
add("kv_scan_range", lambda s, d: pair(scan.scan(live(s, d), "user:000010", "user:000100")), KV + "SELECT key, value FROM live WHERE key >= 'user:000010' AND key < 'user:000100' ORDER BY key")
add("kv_scan_open", lambda s, d: pair(scan.scan(live(s, d), "", "user:000050", 20)), KV + "SELECT key, value FROM live WHERE key < 'user:000050' ORDER BY key LIMIT 20")
add("kv_reverse_scan", lambda s, d: pair(scan.scan(live(s, d), "user:000010", None, 15, reverse=True)), KV + "SELECT key, value FROM live WHERE key >= 'user:000010' ORDER BY key DESC LIMIT 15")
add("kv_prefix", lambda s, d: pair(scan.prefix(live(s, d), "user:00001")), KV + "SELECT key, value FROM live WHERE starts_with(key, 'user:00001')")
add("kv_count_prefix", lambda s, d: scan.prefix(live(s, d), "user:0000").agg(F.count(F.lit(1)).alias("n")), KV + "SELECT count(*) AS n FROM live WHERE starts_with(key, 'user:0000')")
add("kv_tail", lambda s, d: pair(scan.tail(live(s, d), 10)), KV + "SELECT * FROM (SELECT key, value FROM live ORDER BY key DESC LIMIT 10) ORDER BY key")
add("kv_keys", lambda s, d: scan.scan(live(s, d)).select("key"), KV + "SELECT key FROM live ORDER BY key")
add("kv_values", lambda s, d: scan.scan(live(s, d)).select("value"), KV + "SELECT value FROM live")
add("kv_grep", lambda s, d: scan.grep(live(s, d), "5$|^user:0000[12]").select("key"), KV + "SELECT key FROM live WHERE regexp_matches(key, '5$|^user:0000[12]')")
add("kv_scan_filter", lambda s, d: pair(scan.scan_filter(live(s, d), F.col("value").cast("decimal(18,2)") > 100)), KV + "SELECT key, value FROM live WHERE CAST(value AS DECIMAL(18,2)) > 100")
add("kv_first_last", lambda s, d: scan.ends(live(s, d)), KV + "SELECT min(key) AS first_key, arg_min(value, key) AS first_value, max(key) AS last_key, arg_max(value, key) AS last_value FROM live")
add("kv_is_empty", lambda s, d: scan.is_empty(live(s, d)), KV + "SELECT count(*) = 0 AS is_empty FROM live")
add("kv_batches", lambda s, d: scan.batches(live(s, d), 16), KV + "SELECT key, row_number() OVER (ORDER BY key) - 1 AS position, CAST(floor((row_number() OVER (ORDER BY key) - 1) / 16) AS BIGINT) AS batch FROM live")
add("kv_key_stats", lambda s, d: scan.key_stats(live(s, d)), KV + "SELECT count(*) AS keys, CAST(sum(strlen(key)) AS BIGINT) AS key_bytes, CAST(sum(strlen(value)) AS BIGINT) AS value_bytes, CAST(min(strlen(value)) AS INT) AS min_value_bytes, CAST(max(strlen(value)) AS INT) AS max_value_bytes FROM live")
add("kv_sample", lambda s, d: scan.sample(live(s, d), 12), KV + "SELECT key FROM live ORDER BY sha256('0:' || key), key LIMIT 12")
add("kv_key_type", lambda s, d: scan.key_type(kv.latest(kv_log(s, d)), AS_OF), f"WITH {LOG_SQL}, {latest_sql()} SELECT key, CASE WHEN op <> 'P' THEN 'none' WHEN expires_at IS NULL OR expires_at > {AS_OF} THEN 'string' ELSE 'expired' END AS kind FROM latest")
_PROBES = "SELECT DISTINCT 'user:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS key FROM customer"


def _asked(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(user("c_custkey").alias("key")).distinct()


add("kv_mget", lambda s, d: scan.multi_get(_asked(s, d), live(s, d)), KV + f"SELECT p.key, l.value FROM ({_PROBES}) p LEFT JOIN live l ON p.key = l.key")
add("kv_exists_many", lambda s, d: scan.multi_get(_asked(s, d), live(s, d)).select("key", F.col("value").isNotNull().alias("found")), KV + f"SELECT p.key, l.value IS NOT NULL AS found FROM ({_PROBES}) p LEFT JOIN live l ON p.key = l.key")
add("kv_floor_ceiling", lambda s, d: scan.floor_ceiling(_asked(s, d).select(F.col("key").alias("probe")), live(s, d)), KV + f"SELECT p.key AS probe, max(CASE WHEN l.key <= p.key THEN l.key END) AS floor_key, min(CASE WHEN l.key >= p.key THEN l.key END) AS ceiling_key FROM ({_PROBES}) p CROSS JOIN live l GROUP BY p.key")
add("cursor_next", lambda s, d: scan.followed(live(s, d), "user:000020", "user:000060"), KV + "SELECT key, lead(key) OVER (ORDER BY key) AS next_key FROM live WHERE key >= 'user:000020' AND key < 'user:000060'")

# --- expiry, snapshots, compaction ----------------------------------------------------------------------------------------
add("kv_ttl_state", lambda s, d: kv.latest(kv_log(s, d)).select("key", F.when(F.col("op") == "D", "deleted").when(F.col("expires_at").isNull(), "persistent").when(F.col("expires_at") > AS_OF, "expiring").otherwise("expired").alias("state"), (F.col("expires_at") - AS_OF).alias("left_us")), f"WITH {LOG_SQL} SELECT key, CASE WHEN x.op = 'D' THEN 'deleted' WHEN x.expires_at IS NULL THEN 'persistent' WHEN x.expires_at > {AS_OF} THEN 'expiring' ELSE 'expired' END AS state, x.expires_at - {AS_OF} AS left_us FROM (SELECT key, arg_max({{'op': op, 'expires_at': expires_at}}, seq) AS x FROM log GROUP BY key)")
add("kv_expiring_soon", lambda s, d: live(s, d).where(F.col("expires_at") <= AS_OF + 7 * DAY).select("key", "expires_at"), KV + f"SELECT key, expires_at FROM live WHERE expires_at <= {AS_OF + 7 * DAY}")
add("kv_persist", lambda s, d: live(s, d).withColumn("expires_at", F.lit(None).cast("long")).select("key", "value", "expires_at"), KV + "SELECT key, value, CAST(NULL AS BIGINT) AS expires_at FROM live")
add("kv_bulk_expire", lambda s, d: live(s, d).where(F.col("key") < "user:000050").select("key", F.lit(AS_OF + DAY).cast("long").alias("expires_at")), KV + f"SELECT key, CAST({AS_OF + DAY} AS BIGINT) AS expires_at FROM live WHERE key < 'user:000050'")
add("kv_snapshot", lambda s, d: pair(kv.live(kv.snapshot(kv_log(s, d), 5000), AS_OF)), f"WITH {LOG_SQL}, {live_sql('seq <= 5000')} SELECT key, value FROM live")


@query("kv_snapshot_diff", f"WITH {LOG_SQL}, {live_sql('seq <= 5000', 'a')}, {live_sql('true', 'b')} SELECT coalesce(a.key, b.key) AS key, a.value AS before, b.value AS after FROM a FULL JOIN b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value")
def kv_snapshot_diff(s: SparkSession, d: str) -> DataFrame:
    a = pair(kv.live(kv.snapshot(kv_log(s, d), 5000), AS_OF)).withColumnRenamed("value", "before")
    b = pair(live(s, d)).withColumnRenamed("value", "after")
    return a.join(b, "key", "full").where(~F.col("before").eqNullSafe(F.col("after"))).select("key", "before", "after")


add("kv_compact", lambda s, d: pair(kv.live(kv.compact(kv_log(s, d), AS_OF), AS_OF)), KV + "SELECT key, value FROM live")
add("kv_compact_keep_deletes", lambda s, d: kv.compact(kv_log(s, d), AS_OF, False).groupBy("op").agg(F.count(F.lit(1)).alias("n")), f"WITH {LOG_SQL} SELECT x AS op, count(*) AS n FROM (SELECT key, arg_max(op, seq) AS x FROM log GROUP BY key) GROUP BY x")


@query("batch_apply", f"WITH {LOG_SQL}, m AS (SELECT max(seq) + 1 AS seq FROM log), all_ AS (SELECT seq, key, op, value, expires_at FROM log UNION ALL SELECT m.seq, 'user:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0'), CASE WHEN c_custkey % 3 = 0 THEN 'D' ELSE 'P' END, CASE WHEN c_custkey % 3 <> 0 THEN c_name END, NULL FROM customer, m) SELECT key, x.value AS value FROM (SELECT key, arg_max({{'op': op, 'value': value, 'expires_at': expires_at}}, seq) AS x FROM all_ GROUP BY key) WHERE x.op = 'P' AND (x.expires_at IS NULL OR x.expires_at > {AS_OF})")
def batch_apply(s: SparkSession, d: str) -> DataFrame:
    gone = F.col("c_custkey") % 3 == 0
    batch = table(s, d, "customer").select(F.lit(0).alias("ord"), user("c_custkey").alias("key"), F.when(gone, "D").otherwise("P").alias("op"), F.when(~gone, F.col("c_name")).alias("value"), F.lit(None).cast("long").alias("expires_at"))
    return pair(kv.live(kv.append(kv_log(s, d).select("seq", "ord", "key", "op", "value", "expires_at"), batch), AS_OF))


# --- read-modify-write ----------------------------------------------------------------------------------------------------
add("kv_getset", lambda s, d: rmw.getset(kv_log(s, d)), f"WITH {LOG_SQL} SELECT seq, key, {LAG.format('value')} AS old_value FROM log")
add("kv_getdel", lambda s, d: rmw.getdel(kv_log(s, d)), f"WITH {LOG_SQL} SELECT seq, key, old_value FROM (SELECT seq, key, op, {LAG.format('value')} AS old_value FROM log) WHERE op = 'D'")


def _conditional(s: SparkSession, d: str, mode: str) -> DataFrame:
    """Puts of views, clicks and purchases are conditional; signups put always, errors delete."""
    kind = F.col("event_type")
    made = F.when(kind == "error", "D").when(kind == "signup", "P").otherwise(mode)
    return rmw.conditional(kv_log(s, d).withColumn("mode", made))


def _conditional_sql(mode: str) -> str:
    """The same fold by recursion along the operations of each key."""
    return f"""WITH RECURSIVE {LOG_SQL}, o AS (SELECT key, seq, value, expires_at, ts_us, CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'P' ELSE '{mode}' END AS mode, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM log),
 f AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS seq, false AS applied, false AS there, CAST(NULL AS VARCHAR) AS v, CAST(NULL AS BIGINT) AS e FROM o UNION ALL
  SELECT f.key, o.i, o.seq, a, CASE WHEN a THEN o.mode <> 'D' ELSE there END, CASE WHEN a THEN o.value ELSE f.v END, CASE WHEN a THEN o.expires_at ELSE f.e END
  FROM f JOIN o ON o.key = f.key AND o.i = f.i + 1, LATERAL (SELECT f.there AND (f.e IS NULL OR f.e > o.ts_us) AS p), LATERAL (SELECT o.mode IN ('P', 'D') OR p = (o.mode = 'XX') AS a))
 SELECT key, seq, applied FROM f WHERE i > 0"""


add("kv_set_if_absent", lambda s, d: _conditional(s, d, "NX").drop("state"), _conditional_sql("NX"))
add("kv_set_if_present", lambda s, d: _conditional(s, d, "XX").drop("state"), _conditional_sql("XX"))


for _how in ("sum", "max", "min"):
    add(f"kv_running_{_how}", lambda s, d, h=_how: rmw.running(kv_log(s, d).where("op = 'P'"), cents(), h), f"WITH {LOG_SQL} SELECT seq, key, CAST({_how}({CENTS_SQL}) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS state FROM log WHERE op = 'P'")
add("counter_value", lambda s, d: kv_log(s, d).where("op = 'P'").groupBy("key").agg(F.sum(cents()).alias("value")), f"WITH {LOG_SQL} SELECT key, CAST(sum({CENTS_SQL}) AS BIGINT) AS value FROM log WHERE op = 'P' GROUP BY key")
add("kv_append", lambda s, d: rmw.appended(kv_log(s, d)), f"WITH {LOG_SQL} SELECT key, string_agg(value, ',' ORDER BY seq) AS value FROM log WHERE op = 'P' GROUP BY key")


@query("kv_cas_fold", """WITH RECURSIVE o AS (SELECT user_id AS key, event_type AS value, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 'view' ELSE 'signup' END AS expected, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
 f AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS v, CAST(0 AS BIGINT) AS n FROM o UNION ALL SELECT f.key, o.i, CASE WHEN f.v IS NOT DISTINCT FROM o.expected THEN o.value ELSE f.v END, f.n + CASE WHEN f.v IS NOT DISTINCT FROM o.expected THEN 1 ELSE 0 END FROM f JOIN o ON o.key = f.key AND o.i = f.i + 1)
 SELECT 'user:' || lpad(CAST(key AS VARCHAR), 6, '0') AS key, arg_max({'v': v}, i).v AS value, max(n) AS swaps FROM f GROUP BY key""")  # fmt: skip
def kv_cas_fold(s: SparkSession, d: str) -> DataFrame:
    third = F.col("event_id") % 3
    ops = events(s, d).select(F.col("event_id").alias("seq"), user().alias("key"), F.when(third == 1, "view").when(third == 2, "signup").alias("expected"), F.col("event_type").alias("value"))
    return rmw.cas_fold(ops)


@query("lock_fold", f"""WITH RECURSIVE o AS (SELECT user_id % 20 AS name, event_id % 3 AS owner, epoch_us(ts) AS t, CASE event_type WHEN 'purchase' THEN 'extend' WHEN 'error' THEN 'unlock' ELSE 'lock' END AS act, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS i FROM events),
 f AS (SELECT DISTINCT name, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS owner, CAST(NULL AS BIGINT) AS until, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c FROM o UNION ALL
  SELECT f.name, o.i, CASE WHEN got THEN o.owner WHEN freed THEN NULL ELSE f.owner END, CASE WHEN got THEN o.t + {DAY // 4} WHEN freed THEN NULL WHEN more THEN o.t + {DAY // 2} ELSE f.until END,
   f.a + CAST(got AS BIGINT), f.b + CAST(freed AS BIGINT), f.c + CAST(more AS BIGINT)
  FROM f JOIN o ON o.name = f.name AND o.i = f.i + 1, LATERAL (SELECT f.owner IS NOT NULL AND f.until > o.t AS held), LATERAL (SELECT act = 'lock' AND NOT held AS got, act = 'unlock' AND held AND f.owner = o.owner AS freed, act = 'extend' AND held AND f.owner = o.owner AS more))
 SELECT name, arg_max({{'v': owner}}, i).v AS owner, arg_max({{'v': until}}, i).v AS until_us, max(a) AS locks, max(b) AS unlocks, max(c) AS extends FROM f GROUP BY name""")  # fmt: skip
def lock_fold(s: SparkSession, d: str) -> DataFrame:
    """Locks (lock, unlock, extend_lock) of twenty names by three owners; six hours, extended to twelve."""
    action = F.when(F.col("event_type") == "purchase", "extend").when(F.col("event_type") == "error", "unlock").otherwise("lock")
    asked = events(s, d).select((F.col("user_id") % 20).alias("name"), F.col("event_id").alias("seq"), action.alias("action"), (F.col("event_id") % 3).alias("owner"), "ts_us")
    return rmw.lock_fold(asked, DAY // 4, DAY // 2)


add("rate_limit", lambda s, d: rmw.rate_limit(events(s, d).select(F.col("event_id").alias("seq"), F.col("event_type").alias("key"), "ts_us"), 5, DAY // 24), f"SELECT event_id AS seq, event_type AS key, epoch_us(ts) // {DAY // 24} AS slot, row_number() OVER (PARTITION BY event_type, epoch_us(ts) // {DAY // 24} ORDER BY event_id) <= 5 AS allowed FROM events")
_NAMES = "n AS (SELECT 'user:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS key, 'moved:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS new_key FROM customer)"
_PAIRS = "n AS (SELECT DISTINCT 'user:' || lpad(CAST(c_custkey - (c_custkey + 1) % 2 AS VARCHAR), 6, '0') AS key, 'user:' || lpad(CAST(c_custkey - (c_custkey + 1) % 2 + 1 AS VARCHAR), 6, '0') AS new_key FROM customer)"


def _names(s: SparkSession, d: str) -> DataFrame:
    """All customers, to names that no key has."""
    return table(s, d, "customer").select(user("c_custkey").alias("key")).withColumn("new_key", F.concat(F.lit("moved:"), F.substring("key", 6, 20)))


def _neighbours(s: SparkSession, d: str) -> DataFrame:
    """All customers in pairs: an odd number and the next one."""
    return table(s, d, "customer").select((F.col("c_custkey") - (F.col("c_custkey") + 1) % 2).alias("n")).distinct().select(user("n").alias("a"), user(F.col("n") + 1).alias("b"))


def _store(s: SparkSession, d: str) -> Store:
    return Store(kv_log(s, d), AS_OF)


def _after(s: SparkSession, d: str, write) -> DataFrame:
    """Live keys after a batch."""
    store = _store(s, d)
    return store.state(write(store))


_MOVED = "m AS (SELECT n.new_key AS key, l.value, CAST(NULL AS BIGINT) AS expires_at FROM live l JOIN n ON l.key = n.key)"
add("kv_rename", lambda s, d: _after(s, d, lambda x: x.rename(_names(s, d))), f"{KV}, {_NAMES}, {_MOVED} SELECT key, value, expires_at FROM live WHERE key NOT IN (SELECT key FROM n) AND key NOT IN (SELECT key FROM m) UNION ALL SELECT * FROM m")
add("kv_copy", lambda s, d: _after(s, d, lambda x: x.copy(_names(s, d))), f"{KV}, {_NAMES}, {_MOVED} SELECT key, value, expires_at FROM live WHERE key NOT IN (SELECT key FROM m) UNION ALL SELECT * FROM m")
add("kv_swap", lambda s, d: pair(_store(s, d).swap(_neighbours(s, d))), f"{KV}, {_PAIRS}, p AS (SELECT n.key AS a, n.new_key AS b, x.value AS va, y.value AS vb FROM n JOIN live x ON x.key = n.key JOIN live y ON y.key = n.new_key) SELECT a AS key, vb AS value FROM p UNION ALL SELECT b, va FROM p")
add("kv_map_values", lambda s, d: rmw.map_values(live(s, d), F.regexp_replace("value", r"\.\d+$", "")), KV + r"SELECT key, regexp_replace(value, '\.\d+$', '') AS value FROM live WHERE regexp_matches(value, '\.\d+$')")
add("kv_range_delete", lambda s, d: rmw.delete_where(live(s, d), (F.col("key") >= "user:000020") & (F.col("key") < "user:000090")), KV + "SELECT key, value FROM live WHERE NOT (key >= 'user:000020' AND key < 'user:000090')")
add("kv_prefix_delete", lambda s, d: rmw.delete_where(live(s, d), F.col("key").startswith("user:00001")), KV + "SELECT key, value FROM live WHERE NOT starts_with(key, 'user:00001')")
add("kv_delete_many", lambda s, d: _after(s, d, lambda x: x.delete_many(table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(user("c_custkey").alias("key")))), KV + "SELECT key, value, expires_at FROM live WHERE key NOT IN (SELECT 'user:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') FROM customer WHERE c_mktsegment = 'BUILDING')")
add("kv_get_or_set", lambda s, d: scan.multi_get(_asked(s, d), live(s, d)).select("key", F.coalesce("value", F.lit("none")).alias("value")), KV + f"SELECT p.key, coalesce(l.value, 'none') AS value FROM ({_PROBES}) p LEFT JOIN live l ON p.key = l.key")


@query("txn_validate", f"WITH {LOG_SQL}, {live_sql('seq <= 9000', 'a')}, {live_sql()}, r AS (SELECT o_orderkey % 500 AS txn, 'user:' || lpad(CAST(o_custkey % 160 AS VARCHAR), 6, '0') AS key FROM orders) SELECT r.txn, count(*) AS reads, CAST(sum(CASE WHEN a.value IS NOT DISTINCT FROM live.value THEN 0 ELSE 1 END) AS BIGINT) AS conflicts, sum(CASE WHEN a.value IS NOT DISTINCT FROM live.value THEN 0 ELSE 1 END) = 0 AS commits FROM r LEFT JOIN a ON a.key = r.key LEFT JOIN live ON live.key = r.key GROUP BY r.txn")
def txn_validate(s: SparkSession, d: str) -> DataFrame:
    reads = table(s, d, "orders").select((F.col("o_orderkey") % 500).alias("txn"), (F.col("o_custkey") % 160).alias("u")).select("txn", user("u").alias("key"))
    both = kv.two_views(kv_log(s, d), 9000, AS_OF)
    return txn.validate(reads.join(both.select("key", "seen"), "key", "left"), both)


# --- time series ------------------------------------------------------------------------------------------------------------
def _points(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select(F.col("event_type").alias("series"), "ts_us", "value")


_TS = "WITH p AS (SELECT event_type AS series, epoch_us(ts) AS ts_us, value FROM events) "
_AGG = "count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, min(value) AS low, max(value) AS high, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean"
add("ts_range", lambda s, d: st.ts_range(_points(s, d), FROM + DAY, FROM + 2 * DAY), _TS + f"SELECT * FROM p WHERE ts_us BETWEEN {FROM + DAY} AND {FROM + 2 * DAY}")
add("ts_aggregate", lambda s, d: st.ts_aggregate(_points(s, d), FROM, FROM + 20 * DAY), _TS + f"SELECT series, {_AGG} FROM p WHERE ts_us BETWEEN {FROM} AND {FROM + 20 * DAY} GROUP BY series")
add("ts_latest", lambda s, d: st.ts_latest(_points(s, d)), _TS + "SELECT series, max(ts_us) AS ts_us, arg_max(value, ts_us) AS value FROM p GROUP BY series")
add("ts_downsample", lambda s, d: st.ts_downsample(_points(s, d), DAY // 4, FROM + DAY // 3, FROM + 25 * DAY), _TS + f"SELECT series, {FROM + DAY // 3} + ((ts_us - {FROM + DAY // 3}) // {DAY // 4}) * {DAY // 4} AS bucket_us, {_AGG} FROM p WHERE ts_us BETWEEN {FROM + DAY // 3} AND {FROM + 25 * DAY} GROUP BY ALL")


# --- leaderboards -----------------------------------------------------------------------------------------------------------
def _scores(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(F.col("c_nationkey").cast("string").alias("board"), F.col("c_name").alias("member"), (F.col("c_acctbal").cast("decimal(18,2)") * 100).cast("long").alias("score"))


_LB = "WITH b AS (SELECT CAST(c_nationkey AS VARCHAR) AS board, c_name AS member, CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 100 AS BIGINT) AS score FROM customer) "
_RANK = "CAST(row_number() OVER (PARTITION BY board ORDER BY score {0}, member {1}) AS INT) AS place"
add("lb_rank", lambda s, d: st.lb_rank(_scores(s, d)), _LB + f"SELECT *, {_RANK.format('DESC', 'ASC')} FROM b")
add("lb_top", lambda s, d: st.lb_top(_scores(s, d), 5), _LB + f"SELECT * FROM (SELECT *, {_RANK.format('DESC', 'ASC')} FROM b) WHERE place <= 5")
add("lb_bottom", lambda s, d: st.lb_top(_scores(s, d), 5, bottom=True), _LB + f"SELECT * FROM (SELECT *, {_RANK.format('ASC', 'DESC')} FROM b) WHERE place <= 5")
add("lb_range", lambda s, d: st.lb_range(_scores(s, d), 100_000, 300_000), _LB + "SELECT * FROM b WHERE score BETWEEN 100000 AND 300000")
add("lb_size", lambda s, d: _scores(s, d).groupBy("board").agg(F.count(F.lit(1)).alias("members"), F.sum("score").alias("total")), _LB + "SELECT board, count(*) AS members, CAST(sum(score) AS BIGINT) AS total FROM b GROUP BY board")


# --- sets, multimaps, bitmaps, tries, queues --------------------------------------------------------------------------------
def _members(s: SparkSession, d: str) -> DataFrame:
    tier = F.when(F.col("value") >= 100, "large").otherwise("small")
    return table(s, d, "events").select(F.concat("event_type", F.lit(":"), tier).alias("coll"), F.col("user_id").cast("string").alias("member"))


_SET = "WITH m AS (SELECT DISTINCT event_type || CASE WHEN value >= 100 THEN ':large' ELSE ':small' END AS coll, CAST(user_id AS VARCHAR) AS member FROM events) "
for _name, _op in (("union", "UNION"), ("intersection", "INTERSECT"), ("difference", "EXCEPT")):
    _f = {"union": lambda a, b: a.union(b).distinct(), "intersection": lambda a, b: a.intersect(b), "difference": lambda a, b: a.subtract(b)}[_name]
    add(f"set_{_name}", lambda s, d, f=_f: f(st.coll(_members(s, d), "view:large"), st.coll(_members(s, d), "purchase:large")), _SET + f"SELECT member FROM m WHERE coll = 'view:large' {_op} SELECT member FROM m WHERE coll = 'purchase:large'")
add("set_symmetric_difference", lambda s, d: _members(s, d).where("coll IN ('view:large', 'purchase:large')").groupBy("member").agg(F.count_distinct("coll").alias("c")).where("c = 1").select("member"), _SET + "SELECT member FROM m WHERE coll IN ('view:large', 'purchase:large') GROUP BY member HAVING count(*) = 1")
add("set_relations", lambda s, d: st.set_relations(_members(s, d), "purchase:large", "view:large"), _SET + ", a AS (SELECT member FROM m WHERE coll = 'purchase:large'), b AS (SELECT member FROM m WHERE coll = 'view:large'), c AS (SELECT (SELECT count(*) FROM a) AS size_a, (SELECT count(*) FROM b) AS size_b, (SELECT count(*) FROM a JOIN b USING (member)) AS both_) SELECT size_a, size_b, both_ AS both, both_ = size_a AS a_subset_b, both_ = size_b AS a_superset_b, both_ = 0 AS disjoint FROM c")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_brand").alias("key"), F.col("p_type").alias("value"))


_MM = "WITH m AS (SELECT DISTINCT p_brand AS key, p_type AS value FROM part) "
add("mm_get", lambda s, d: _pairs(s, d).where("key LIKE '%1'").distinct(), _MM + "SELECT * FROM m WHERE key LIKE '%1'")
add("mm_as_dict", lambda s, d: st.mm_dict(_pairs(s, d)), _MM + "SELECT key, count(*) AS n, string_agg(value, ',' ORDER BY value) AS values_joined FROM m GROUP BY key")
add("mm_items", lambda s, d: st.mm_items(_pairs(s, d)), _MM + "SELECT * FROM m ORDER BY length(key), key, value")


def _bits(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("event_type").alias("name"), (F.col("user_id") * 97).alias("bit"))


_BIT = "WITH b AS (SELECT DISTINCT event_type AS name, user_id * 97 AS bit FROM events) "
add("bitmap_count", lambda s, d: st.bitmap_count(_bits(s, d)), _BIT + "SELECT name, count(*) AS n_set FROM b GROUP BY name")
add("bitmap_range_count", lambda s, d: st.bitmap_count(_bits(s, d), 1000, 9000), _BIT + "SELECT name, count(*) AS n_set FROM b WHERE bit >= 1000 AND bit < 9000 GROUP BY name")
add("bitmap_chunks", lambda s, d: st.bitmap_chunks(_bits(s, d)), _BIT + "SELECT name, bit // 4096 AS chunk, count(*) AS n_set, min(bit) AS first_bit, max(bit) AS last_bit FROM b GROUP BY ALL")
add("bitmap_both", lambda s, d: st.bitmap_both(_bits(s, d), "click", "error"), _BIT + ", x AS (SELECT bit, count(*) AS c FROM b WHERE name IN ('click', 'error') GROUP BY bit) SELECT count(*) FILTER (c = 2) AS n_and, count(*) AS n_or, count(*) FILTER (c = 1) AS n_xor FROM x")


def _words(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))


_WORD = "WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part) "
add("trie_search", lambda s, d: st.trie_search(_words(s, d), "p", 10), _WORD + "SELECT word FROM w WHERE starts_with(word, 'p') ORDER BY word LIMIT 10")
add("trie_prefix_counts", lambda s, d: st.trie_prefixes(_words(s, d), 2), _WORD + "SELECT substr(word, 1, 2) AS prefix, count(*) AS n FROM w GROUP BY ALL")
add("trie_longest_prefix", lambda s, d: st.trie_longest_prefix(table(s, d, "part").select(F.substring("p_type", 1, 3).alias("word")), table(s, d, "part").select(F.col("p_type").alias("text")).distinct()), "WITH w AS (SELECT DISTINCT substr(p_type, 1, 3) AS word FROM part) SELECT text, arg_max(word, length(word)) AS longest FROM (SELECT DISTINCT p_type AS text FROM part) t JOIN w ON starts_with(t.text, w.word) GROUP BY text")


def _queue(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderstatus").alias("name"), F.col("o_orderkey").alias("seq"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"))


_QU = "WITH q AS (SELECT o_orderstatus AS name, o_orderkey AS seq, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority FROM orders) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY {0}) AS INT) AS place FROM q) WHERE place <= 25"
add("queue_drain", lambda s, d: st.drain(_queue(s, d), 25), _QU.format("seq"))
add("pq_drain", lambda s, d: st.drain_by_priority(_queue(s, d), 25), _QU.format("priority DESC, seq"))
add("queue_sizes", lambda s, d: _queue(s, d).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("peek")), "SELECT o_orderstatus AS name, count(*) AS n, min(o_orderkey) AS peek FROM orders GROUP BY ALL")


# --- graphs -----------------------------------------------------------------------------------------------------------------
def _edges(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("src"), (F.col("event_id") * 31 % 150).alias("dst")).distinct()


_EDGE = "e AS (SELECT DISTINCT user_id AS src, event_id * 31 % 150 AS dst FROM events WHERE event_type = 'purchase' )"
_BFS = f"WITH RECURSIVE {_EDGE}, r AS (SELECT CAST(7 AS BIGINT) AS node, CAST(0 AS BIGINT) AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 8), b AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)"
add("graph_degrees", lambda s, d: graph.degrees(_edges(s, d)), f"WITH {_EDGE} SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node")
add("graph_neighbors", lambda s, d: _edges(s, d).where("src = 7").select("dst"), f"WITH {_EDGE} SELECT dst FROM e WHERE src = 7")
add("graph_bfs", lambda s, d: graph.bfs(_edges(s, d), 7, 8), _BFS + " SELECT node, depth FROM b")
add("graph_shortest_path", lambda s, d: graph.bfs(_edges(s, d), 7, path=True), f"WITH RECURSIVE {_EDGE}, r AS (SELECT CAST(7 AS BIGINT) AS node, CAST(0 AS BIGINT) AS depth, '7' AS path UNION ALL SELECT e.dst, r.depth + 1, min(r.path || '>' || CAST(e.dst AS VARCHAR)) FROM r JOIN e ON e.src = r.node WHERE r.depth < 30 GROUP BY e.dst, r.depth) SELECT node, min(depth) AS depth, arg_min(path, {{'d': depth, 'p': path}}) AS path FROM r GROUP BY node")


# --- text index, sketches, metrics ------------------------------------------------------------------------------------------
def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text")


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_TOK = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda w: length(w) >= 2 AND NOT list_contains([{_STOP}], w))"
_POST = f"p AS (SELECT DISTINCT doc_id, unnest({_TOK}) AS token FROM documents)"
add("idx_token_counts", lambda s, d: text.postings(_docs(s, d)).groupBy("token").agg(F.count(F.lit(1)).alias("docs")), f"WITH {_POST} SELECT token, count(*) AS docs FROM p GROUP BY token")
add("idx_search", lambda s, d: text.search(_docs(s, d), table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 5), f"""WITH {_POST}, w AS (SELECT item_id AS query_id, {_TOK} AS t FROM benchmark), q AS (SELECT query_id, unnest(t) AS token, unnest(range(len(t))) AS place FROM w),
 c AS (SELECT query_id, doc_id, count(*) AS score, min(q.place) AS met FROM p JOIN q USING (token) GROUP BY ALL) SELECT query_id, doc_id, score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, met, doc_id) AS INT) AS place FROM c) WHERE place <= 5""")


def _items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_type", F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("item"))


_WORD32 = "CAST('0x' || substr(sha256('user:' || CAST({0} AS VARCHAR)), {1}, 8) AS BIGINT)"
_HASHES = f"h AS (SELECT event_type AS name, {_WORD32.format('user_id', 1)} AS hi, {_WORD32.format('user_id', 9)} AS lo FROM events)"
_RHO = "max(56 - CASE WHEN (hi << 23) | (lo >> 9) = 0 THEN 0 ELSE length(bin((hi << 23) | (lo >> 9))) END)"
_REG = f"WITH {_HASHES}, r AS (SELECT name, lo & 511 AS bucket, CAST({_RHO} AS INT) AS rho FROM h GROUP BY ALL) "
_COUNT = f"s AS (SELECT name, count(*) AS used, sum(pow(2.0, -rho)) AS z FROM {{0}} GROUP BY name), t AS (SELECT *, {sketch.ALPHA * 512 * 512!r} / (z + 512 - used) AS raw FROM s) SELECT name, used, CAST(round(CASE WHEN raw <= 1280 AND used < 512 THEN 512 * ln(512.0 / (512 - used)) ELSE raw END) AS BIGINT) AS estimate FROM t"
add("hll_registers", lambda s, d: sketch.registers(_items(s, d), "event_type", "item"), _REG + "SELECT name, bucket, rho FROM r")
add("hll_estimate", lambda s, d: sketch.estimate(sketch.registers(_items(s, d), "event_type", "item")), _REG + ", " + _COUNT.format("r"))
add("hll_merge", lambda s, d: sketch.estimate(sketch.merge(sketch.registers(_items(s, d), "event_type", "item"), "all")), _REG + ", m AS (SELECT 'all' AS name, bucket, max(rho) AS rho FROM r GROUP BY bucket), " + _COUNT.format("m"))
_BLOOM = f"""WITH i AS (SELECT DISTINCT user_id AS u FROM events WHERE event_type = 'purchase'), n AS (SELECT greatest(1, count(*)) AS n FROM i), z AS (SELECT CAST(ceil(-n * ln(0.01) / pow(ln(2), 2)) AS BIGINT) AS m, n FROM n),
 k AS (SELECT m, greatest(1, CAST(round(m / n * ln(2)) AS BIGINT)) AS k FROM z),
 a AS (SELECT u, CAST({_WORD32.format('u', 1)} AS HUGEINT) * 4294967296 + {_WORD32.format('u', 9)} AS x, CAST({_WORD32.format('u', 17)} AS HUGEINT) * 4294967296 + {_WORD32.format('u', 25)} AS y FROM (SELECT u FROM i UNION SELECT c_custkey FROM customer)),
 b AS (SELECT u, (x + j * y) % m AS bit FROM a, k, LATERAL (SELECT unnest(range(k)) AS j)),
 held AS (SELECT DISTINCT bit FROM b WHERE u IN (SELECT u FROM i)) """
add("bloom_size", lambda s, d: _bloom_size(s, d), _BLOOM + "SELECT m AS bits, k AS hashes FROM k")
add("bloom_bits", lambda s, d: _bloom(s, d)[0], _BLOOM + "SELECT CAST(bit AS BIGINT) AS bit FROM held")


def _bloom(s: SparkSession, d: str) -> tuple[DataFrame, int, int]:
    items = _items(s, d).where("event_type = 'purchase'").select("item").distinct()
    bits, hashes = sketch.bloom_size(items.count())
    return sketch.bloom_bits(items, "item", bits, hashes), bits, hashes


def _bloom_size(s: SparkSession, d: str) -> DataFrame:
    _, bits, hashes = _bloom(s, d)
    return s.range(1).select(F.lit(bits).cast("long").alias("bits"), F.lit(hashes).cast("long").alias("hashes"))


@query("bloom_probe", _BLOOM + "SELECT 'user:' || CAST(u AS VARCHAR) AS item, bool_and(bit IN (SELECT bit FROM held)) AS maybe FROM b WHERE u IN (SELECT c_custkey FROM customer) GROUP BY u")
def bloom_probe(s: SparkSession, d: str) -> DataFrame:
    held, bits, hashes = _bloom(s, d)
    probes = table(s, d, "customer").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("item"))
    return sketch.bloom_probe(probes, "item", held, bits, hashes)


_CASE = "CASE " + " ".join(f"WHEN value <= {b} THEN {b}" for b in metrics.BOUNDS) + " ELSE CAST('infinity' AS DOUBLE) END"
_HIST = f"WITH h AS (SELECT event_type AS name, CAST({_CASE} AS DOUBLE) AS upper, count(*) AS n, sum(CAST(value AS DECIMAL(18,2))) AS total FROM events GROUP BY ALL), c AS (SELECT name, upper, sum(n) OVER (PARTITION BY name ORDER BY upper) AS c, sum(n) OVER (PARTITION BY name) AS t FROM h), q AS (SELECT name, percent, min(upper) AS p_upper FROM c, (SELECT unnest([50.0, 90.0, 99.0, 99.9]) AS percent) WHERE c * 100 >= t * percent GROUP BY ALL)"


def _histogram(s: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(table(s, d, "events"), "event_type", "value")


add("latency_histogram", lambda s, d: _histogram(s, d).drop("total"), _HIST + " SELECT name, upper, n FROM h")
add("latency_percentile", lambda s, d: metrics.percentiles(_histogram(s, d), 50, 90, 99, 99.9), _HIST + " SELECT name, CAST(percent AS DOUBLE) AS percent, p_upper FROM q")
add("latency_mean", lambda s, d: metrics.mean(_histogram(s, d)), _HIST + " SELECT name, CAST(sum(total) AS DOUBLE) / sum(n) AS mean_us, CAST(sum(n) AS BIGINT) AS count FROM h GROUP BY name")
add("latency_snapshot", lambda s, d: metrics.snapshot(_histogram(s, d)), _HIST + ", m AS (SELECT name, round(CAST(sum(total) AS DOUBLE) / sum(n), 1) AS mean_us, CAST(sum(n) AS BIGINT) AS count FROM h GROUP BY name) SELECT name, max(CASE WHEN percent = 50 THEN p_upper END) AS p50_us, max(CASE WHEN percent = 99 THEN p_upper END) AS p99_us, max(CASE WHEN percent = 99.9 THEN p_upper END) AS p999_us, any_value(mean_us) AS mean_us, any_value(count) AS count FROM q JOIN m USING (name) GROUP BY name")

#: Further queries, by subject.
for _module in ("store", "structures", "files"):
    importlib.import_module(f"lodestrata.queries.{_module}")


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
