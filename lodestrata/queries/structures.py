"""Writes to the typed structures as operations in order, and the reads of what they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.inputs import CENTS_SQL, DAY, FROM, cents, events, table
from lodestrata.operators import graph, text
from lodestrata.operators import structures as st
from lodestrata.plans.folds import current
from lodestrata.registry import add


def _op(**kinds: str) -> Column:
    """An operation for each event type."""
    out = F.lit(None).cast("string")
    for kind, op in kinds.items():
        out = F.when(F.col("event_type") == kind, op).otherwise(out)
    return out


def _op_sql(**kinds: str) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{o}'" for k, o in kinds.items()) + " END"


# --- time series --------------------------------------------------------------------------------------------------------------
def _points(s: SparkSession, d: str) -> DataFrame:
    """Points of each event type at whole hours: many share a time."""
    hour = F.floor(F.col("ts_us") / (DAY // 24)) * (DAY // 24)
    return events(s, d).select(F.col("event_type").alias("series"), hour.cast("long").alias("ts_us"), F.col("event_id").alias("seq"), "value")


def _crowded(s: SparkSession, d: str) -> DataFrame:
    """Points at times so close that moved ones meet others."""
    return table(s, d, "events").select(F.col("event_type").alias("series"), (F.col("event_id") * 7919 % 3001).alias("ts_us"), F.col("event_id").alias("seq"), "value")


_HOURS = f"p AS (SELECT event_type AS series, epoch_us(ts) // {DAY // 24} * {DAY // 24} AS ts_us, event_id AS seq, value FROM events)"
_BUMPED = f"WITH {_HOURS}, b AS (SELECT series, ts_us + row_number() OVER (PARTITION BY series, ts_us ORDER BY seq) - 1 AS ts_us, seq, value FROM p) "
add("ts_add", lambda s, d: st.bumped(_points(s, d)), _BUMPED + "SELECT series, ts_us, seq, value FROM b")
add("ts_add_cascading", lambda s, d: st.bumped(_crowded(s, d)), None)  # in order: tested against brute force
add("ts_add_many", lambda s, d: st.added_together(_points(s, d)), f"WITH {_HOURS} SELECT series, ts_us, arg_max(value, seq) AS value FROM p GROUP BY ALL")
_TS = "WITH p AS (SELECT event_type AS series, epoch_us(ts) AS ts_us, value FROM events) "


def _series(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select(F.col("event_type").alias("series"), "ts_us", "value")


add("ts_first", lambda s, d: st.ts_first(_series(s, d)), _TS + "SELECT series, min(ts_us) AS ts_us, arg_min(value, ts_us) AS value FROM p GROUP BY series")
add("ts_newest", lambda s, d: st.ts_newest(_series(s, d), 4), _TS + "SELECT series, ts_us, value FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts_us DESC) AS r FROM p) WHERE r <= 4")
add("ts_count", lambda s, d: st.ts_range(_series(s, d), FROM + DAY, FROM + 9 * DAY).groupBy("series").agg(F.count(F.lit(1)).alias("n")), _TS + f"SELECT series, count(*) AS n FROM p WHERE ts_us BETWEEN {FROM + DAY} AND {FROM + 9 * DAY} GROUP BY series")
add("ts_delete_before", lambda s, d: _series(s, d).where(F.col("ts_us") >= FROM + 10 * DAY), _TS + f"SELECT series, ts_us, value FROM p WHERE ts_us >= {FROM + 10 * DAY}")
add("ts_deleted_counts", lambda s, d: _series(s, d).groupBy("series").agg(F.count_if(F.col("ts_us") < FROM + 10 * DAY).alias("before"), F.count(F.lit(1)).alias("cleared")), _TS + f"SELECT series, count(*) FILTER (ts_us < {FROM + 10 * DAY}) AS before, count(*) AS cleared FROM p GROUP BY series")

# --- leaderboards ---------------------------------------------------------------------------------------------------------------
_LB_OPS = {"view": "add", "click": "update", "purchase": "update", "signup": "add", "error": "remove"}


def _score_ops(s: SparkSession, d: str) -> DataFrame:
    """Two boards (even and odd users); the first event of a tenth day empties its board."""
    board = (F.col("user_id") % 2).cast("string")
    op = F.when((F.col("event_id") % 1000 == 500), "clear").otherwise(_op(**_LB_OPS))
    return table(s, d, "events").select(board.alias("board"), F.when(op != "clear", F.col("user_id").cast("string")).alias("member"), op.alias("op"), cents().alias("amount"), F.col("event_id").alias("seq"))


_LB = f"""WITH o AS (SELECT CAST(user_id % 2 AS VARCHAR) AS board, CAST(user_id AS VARCHAR) AS member, CASE WHEN event_id % 1000 = 500 THEN 'clear' ELSE {_op_sql(**_LB_OPS)} END AS op, {CENTS_SQL} AS amount, event_id AS seq FROM events),
 w AS (SELECT board, max(seq) AS wiped FROM o WHERE op = 'clear' GROUP BY board), k AS (SELECT o.* FROM o LEFT JOIN w USING (board) WHERE op <> 'clear' AND (wiped IS NULL OR seq > wiped)),
 r AS (SELECT board, member, max(seq) AS made, arg_max({{'v': CASE WHEN op = 'add' THEN amount END}}, seq).v AS base FROM k WHERE op IN ('add', 'remove') GROUP BY ALL),
 u AS (SELECT k.board, k.member, count(*) AS n, sum(amount) AS total FROM k LEFT JOIN r ON r.board = k.board AND r.member = k.member WHERE op = 'update' AND (made IS NULL OR seq > made) GROUP BY ALL),
 b AS (SELECT coalesce(r.board, u.board) AS board, coalesce(r.member, u.member) AS member, CAST(coalesce(base, 0) + coalesce(total, 0) AS BIGINT) AS score FROM r FULL JOIN u ON u.board = r.board AND u.member = r.member WHERE base IS NOT NULL OR n > 0) """


def _board(s: SparkSession, d: str) -> DataFrame:
    return st.scores(_score_ops(s, d))


def _people(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("member"))


add("lb_state", _board, _LB + "SELECT board, member, score FROM b")
add("lb_score", lambda s, d: _people(s, d).join(_board(s, d), "member", "left").select("member", "score"), _LB + "SELECT CAST(c_custkey AS VARCHAR) AS member, score FROM customer LEFT JOIN b ON b.member = CAST(c_custkey AS VARCHAR)")
add("lb_has", lambda s, d: _people(s, d).join(_board(s, d), "member", "left").select("member", F.col("score").isNotNull().alias("found")), _LB + "SELECT CAST(c_custkey AS VARCHAR) AS member, score IS NOT NULL AS found FROM customer LEFT JOIN b ON b.member = CAST(c_custkey AS VARCHAR)")
add("lb_members", lambda s, d: st.lb_rank(_board(s, d)).orderBy("board", "place"), _LB + "SELECT board, member, score, CAST(row_number() OVER (PARTITION BY board ORDER BY score DESC, member) AS INT) AS place FROM b")
add("lb_cleared", lambda s, d: _board(s, d).groupBy("board").agg(F.count(F.lit(1)).alias("cleared")), _LB + "SELECT board, count(*) AS cleared FROM b GROUP BY board")

# --- bitmaps ----------------------------------------------------------------------------------------------------------------------
_BIT_OPS = {"view": "set", "click": "toggle", "purchase": "set", "signup": "clear", "error": "toggle"}


def _bit_ops(s: SparkSession, d: str) -> DataFrame:
    """Single bits; a purchase sets and a signup clears a range of sixteen."""
    low = F.col("user_id") * 97 % 9000
    width = F.when(F.col("event_type").isin("purchase", "signup"), 16).otherwise(1)
    return table(s, d, "events").select((F.col("user_id") % 3).cast("string").alias("name"), low.alias("low"), (low + width).alias("high"), _op(**_BIT_OPS).alias("op"), F.col("event_id").alias("seq"))


def _bitmap(s: SparkSession, d: str) -> DataFrame:
    return st.bits_after(_bit_ops(s, d))


_BM = f"""WITH o AS (SELECT CAST(user_id % 3 AS VARCHAR) AS name, unnest(range(user_id * 97 % 9000, user_id * 97 % 9000 + CASE WHEN event_type IN ('purchase', 'signup') THEN 16 ELSE 1 END)) AS bit, {_op_sql(**_BIT_OPS)} AS op, event_id AS seq FROM events),
 r AS (SELECT name, bit, max(seq) AS made, arg_max(op, seq) AS op FROM o WHERE op <> 'toggle' GROUP BY ALL), t AS (SELECT o.name, o.bit, count(*) AS n FROM o LEFT JOIN r ON r.name = o.name AND r.bit = o.bit WHERE o.op = 'toggle' AND (made IS NULL OR o.seq > made) GROUP BY ALL),
 b AS (SELECT name, bit FROM (SELECT coalesce(r.name, t.name) AS name, coalesce(r.bit, t.bit) AS bit, CASE WHEN r.op = 'set' THEN 1 ELSE 0 END + coalesce(n, 0) AS v FROM r FULL JOIN t ON t.name = r.name AND t.bit = r.bit) WHERE v % 2 = 1) """
add("bitmap_state", _bitmap, _BM + "SELECT name, bit FROM b")
add("bitmap_set_bits", lambda s, d: _bitmap(s, d).where("bit < 4500").orderBy("name", "bit"), _BM + "SELECT name, bit FROM b WHERE bit < 4500")
add("bitmap_get", lambda s, d: _bit_ops(s, d).select("name", F.col("low").alias("bit")).distinct().join(_bitmap(s, d).withColumn("value", F.lit(True)), ["name", "bit"], "left").select("name", "bit", F.coalesce("value", F.lit(False)).alias("value")), _BM + ", a AS (SELECT DISTINCT CAST(user_id % 3 AS VARCHAR) AS name, user_id * 97 % 9000 AS bit FROM events) SELECT a.name, a.bit, b.bit IS NOT NULL AS value FROM a LEFT JOIN b ON b.name = a.name AND b.bit = a.bit")
add("bitmap_any_set", lambda s, d: _bitmap(s, d).groupBy("name").agg(F.bool_or((F.col("bit") >= 100) & (F.col("bit") < 300)).alias("any_set")), _BM + "SELECT name, bool_or(bit >= 100 AND bit < 300) AS any_set FROM b GROUP BY name")
add("bitmap_range_sizes", lambda s, d: _bit_ops(s, d).groupBy("name", "op").agg(F.sum(F.col("high") - F.col("low")).alias("bits")), _BM + "SELECT name, op, count(*) AS bits FROM o GROUP BY ALL")
add("bitmap_cleared_chunks", lambda s, d: _bitmap(s, d).groupBy("name").agg(F.count_distinct(F.floor(F.col("bit") / st.CHUNK_BITS)).alias("chunks")), _BM + "SELECT name, count(DISTINCT bit // 4096) AS chunks FROM b GROUP BY name")

# --- collections, multimaps, tries ----------------------------------------------------------------------------------------------
_SET_OPS = {"view": "add", "click": "remove", "purchase": "add", "signup": "add", "error": "remove"}


def _set_ops(s: SparkSession, d: str) -> DataFrame:
    """Three collections; an operation of a thousand empties its collection."""
    op = F.when(F.col("event_id") % 1000 == 700, "clear").otherwise(_op(**_SET_OPS))
    return table(s, d, "events").select((F.col("user_id") % 3).cast("string").alias("coll"), F.when(op != "clear", F.concat(F.lit("m"), (F.col("event_id") % 400).cast("string"))).alias("member"), op.alias("op"), F.col("event_id").alias("seq"))


def _sets(s: SparkSession, d: str) -> DataFrame:
    return current(_set_ops(s, d), ["coll", "member"], "seq", ["coll"])


_CL = f"""WITH o AS (SELECT CAST(user_id % 3 AS VARCHAR) AS coll, 'm' || CAST(event_id % 400 AS VARCHAR) AS member, CASE WHEN event_id % 1000 = 700 THEN 'clear' ELSE {_op_sql(**_SET_OPS)} END AS op, event_id AS seq FROM events),
 w AS (SELECT coll, max(seq) AS wiped FROM o WHERE op = 'clear' GROUP BY coll), m AS (SELECT l.coll, l.member FROM (SELECT coll, member, arg_max(op, seq) AS op, max(seq) AS made FROM o WHERE op <> 'clear' GROUP BY ALL) l LEFT JOIN w USING (coll) WHERE op = 'add' AND (wiped IS NULL OR made > wiped)) """
_MEMBERS = "SELECT DISTINCT 'm' || CAST(c_custkey AS VARCHAR) AS member FROM customer"


def _asked_members(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("member")).distinct()


add("coll_state", lambda s, d: _sets(s, d).orderBy("coll", "member"), _CL + "SELECT coll, member FROM m")
add("coll_counts", lambda s, d: _sets(s, d).groupBy("coll").agg(F.count(F.lit(1)).alias("n"), F.min("member").alias("popped")), _CL + "SELECT coll, count(*) AS n, min(member) AS popped FROM m GROUP BY coll")
add("coll_contains", lambda s, d: _asked_members(s, d).join(_sets(s, d).where("coll = '1'"), "member", "left").select("member", F.col("coll").isNotNull().alias("found")), _CL + f"SELECT a.member, m.member IS NOT NULL AS found FROM ({_MEMBERS}) a LEFT JOIN m ON m.member = a.member AND coll = '1'")
_NEWS = "SELECT {0}, count(*) FILTER (op = 'add' AND coalesce(before, '') <> 'add') AS added, count(*) FILTER (op = 'remove' AND before = 'add') AS removed FROM (SELECT *, lag(op) OVER (PARTITION BY {1} ORDER BY seq) AS before FROM o WHERE op <> 'clear') GROUP BY {0}"
add("coll_changes", lambda s, d: st.news(_set_ops(s, d).where("op <> 'clear'"), ["coll", "member"], ["coll"]), _CL + _NEWS.format("coll", "coll, member"))


def _pair_ops(s: SparkSession, d: str) -> DataFrame:
    """Key and value by user and event; an error removes everything of its key."""
    op = F.when(F.col("event_type") == "error", "clear").when(F.col("event_type") == "click", "remove").otherwise("add")
    return table(s, d, "events").select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), F.when(op != "clear", F.concat(F.lit("v"), (F.col("event_id") % 7).cast("string"))).alias("value"), op.alias("op"), F.col("event_id").alias("seq"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return current(_pair_ops(s, d), ["key", "value"], "seq", ["key"])


_MM = """WITH o AS (SELECT 'k' || CAST(user_id AS VARCHAR) AS key, 'v' || CAST(event_id % 7 AS VARCHAR) AS value, CASE event_type WHEN 'error' THEN 'clear' WHEN 'click' THEN 'remove' ELSE 'add' END AS op, event_id AS seq FROM events),
 w AS (SELECT key, max(seq) AS wiped FROM o WHERE op = 'clear' GROUP BY key), m AS (SELECT l.key, l.value FROM (SELECT key, value, arg_max(op, seq) AS op, max(seq) AS made FROM o WHERE op <> 'clear' GROUP BY ALL) l LEFT JOIN w USING (key) WHERE op = 'add' AND (wiped IS NULL OR made > wiped)) """
add("mm_state", _pairs, _MM + "SELECT key, value FROM m")
add("mm_counts", lambda s, d: _pairs(s, d).groupBy("key").agg(F.count(F.lit(1)).alias("n")), _MM + "SELECT key, count(*) AS n FROM m GROUP BY key")
add("mm_total_count", lambda s, d: _pairs(s, d).agg(F.count(F.lit(1)).alias("total")), _MM + "SELECT count(*) AS total FROM m")
add("mm_keys", lambda s, d: _pairs(s, d).select("key").distinct().orderBy("key"), _MM + "SELECT DISTINCT key FROM m")
add("mm_contains", lambda s, d: _pair_ops(s, d).select("key").distinct().withColumn("value", F.lit("v3")).join(_pairs(s, d).withColumn("x", F.lit(1)), ["key", "value"], "left").select("key", F.col("x").isNotNull().alias("found")), _MM + "SELECT DISTINCT o.key, m.key IS NOT NULL AS found FROM o LEFT JOIN m ON m.key = o.key AND m.value = 'v3'")
add("mm_changes", lambda s, d: st.news(_pair_ops(s, d).where("op <> 'clear'"), ["key", "value"], ["key"]), _MM + _NEWS.format("key", "key, value"))


def _word_ops(s: SparkSession, d: str) -> DataFrame:
    """Words of part names are inserted; the last word of a large part is deleted."""
    words = F.split(F.lower("p_name"), " ")
    rows = table(s, d, "part").select("p_partkey", "p_size", F.posexplode(words).alias("i", "word"), F.size(words).alias("n"))
    gone = (F.col("p_size") >= 40) & (F.col("i") == F.col("n") - 1)
    return rows.select("word", F.when(gone, "remove").otherwise("add").alias("op"), (F.col("p_partkey") * 100 + F.col("i")).alias("seq"))


def _trie(s: SparkSession, d: str) -> DataFrame:
    return current(_word_ops(s, d), ["word"], "seq")


_TR = """WITH l AS (SELECT p_partkey, p_size, string_split(lower(p_name), ' ') AS w FROM part), x AS (SELECT p_partkey, p_size, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM l),
 o AS (SELECT word, CASE WHEN p_size >= 40 AND i = n - 1 THEN 'remove' ELSE 'add' END AS op, p_partkey * 100 + i AS seq FROM x), t AS (SELECT word FROM (SELECT word, arg_max(op, seq) AS op FROM o GROUP BY word) WHERE op = 'add') """
add("trie_state", lambda s, d: _trie(s, d).orderBy("word"), _TR + "SELECT word FROM t")
add("trie_count", lambda s, d: _trie(s, d).agg(F.count(F.lit(1)).alias("words")), _TR + "SELECT count(*) AS words FROM t")
add("trie_contains", lambda s, d: _word_ops(s, d).select("word").distinct().join(_trie(s, d).withColumn("x", F.lit(1)), "word", "left").select("word", F.col("x").isNotNull().alias("found")), _TR + "SELECT DISTINCT o.word, t.word IS NOT NULL AS found FROM o LEFT JOIN t ON t.word = o.word")
add("trie_starts_with", lambda s, d: _trie(s, d).where(F.col("word").startswith("b")).limit(1).agg((F.count(F.lit(1)) > 0).alias("found")), _TR + "SELECT count(*) > 0 AS found FROM t WHERE starts_with(word, 'b')")
add("trie_changes", lambda s, d: st.news(_word_ops(s, d).withColumn("t", F.lit(1)), ["word"], ["t"]).drop("t"), _TR + "SELECT count(*) FILTER (op = 'add' AND coalesce(before, '') <> 'add') AS added, count(*) FILTER (op = 'remove' AND before = 'add') AS removed FROM (SELECT *, lag(op) OVER (PARTITION BY word ORDER BY seq) AS before FROM o)")


# --- queues and counters ----------------------------------------------------------------------------------------------------------
def _queue_ops(s: SparkSession, d: str) -> DataFrame:
    """A queue for each of twelve groups of users: clicks and errors pop, other events push their number."""
    op = F.when(F.col("event_type").isin("click", "error"), "pop").otherwise("push")
    return table(s, d, "events").select((F.col("user_id") % 12).alias("name"), F.col("event_id").alias("seq"), op.alias("op"), F.col("event_type").alias("item"), F.floor("value").cast("int").alias("priority"))


_QU = """WITH o AS (SELECT user_id % 12 AS name, event_id AS seq, CASE WHEN event_type IN ('click', 'error') THEN 'pop' ELSE 'push' END AS op, event_type AS item FROM events),
 l AS (SELECT *, sum(CASE op WHEN 'push' THEN 1 ELSE -1 END) OVER (PARTITION BY name ORDER BY seq) AS s FROM o), t AS (SELECT name, count(*) FILTER (op = 'pop') + least(min(s), 0) AS taken FROM l GROUP BY name),
 p AS (SELECT name, seq, item, row_number() OVER (PARTITION BY name ORDER BY seq) AS place FROM o WHERE op = 'push'), q AS (SELECT p.name, CAST(place - taken AS INT) AS place, seq, item FROM p JOIN t USING (name) WHERE place > taken) """
add("queue_state", lambda s, d: st.queue_after(_queue_ops(s, d)).orderBy("name", "place"), _QU + "SELECT name, place, seq, item FROM q")
add("queue_length", lambda s, d: st.queue_after(_queue_ops(s, d)).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min_by("seq", "place").alias("head")), _QU + "SELECT name, count(*) AS n, arg_min(seq, place) AS head FROM q GROUP BY name")
add("queue_push_counts", lambda s, d: _queue_ops(s, d).groupBy("name").agg(F.count_if(F.col("op") == "push").alias("pushes"), F.count_if(F.col("op") == "pop").alias("pops")), _QU + "SELECT name, count(*) FILTER (op = 'push') AS pushes, count(*) FILTER (op = 'pop') AS pops FROM o GROUP BY name")
add("queue_pop", lambda s, d: st.queue_pops(_queue_ops(s, d)), None)  # in order: tested against brute force, as the next
add("pq_pop", lambda s, d: st.priority_pops(_queue_ops(s, d)), None)
_PQ = "WITH q AS (SELECT o_orderstatus AS name, o_orderkey AS seq, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority FROM orders) "


def _orders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderstatus").alias("name"), F.col("o_orderkey").alias("seq"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"))


add("pq_peek", lambda s, d: _orders(s, d).groupBy("name").agg(F.max(F.struct("priority", (-F.col("seq")).alias("o"))).alias("x")).select("name", (-F.col("x.o")).alias("seq"), "x.priority"), _PQ + "SELECT name, seq, priority FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY priority DESC, seq) AS r FROM q) WHERE r = 1")
add("pq_count", lambda s, d: _orders(s, d).groupBy("name", "priority").agg(F.count(F.lit(1)).alias("n")), _PQ + "SELECT name, priority, count(*) AS n FROM q GROUP BY ALL")
_CT_OPS = {"view": "incr", "click": "decr", "purchase": "incr", "signup": "reset", "error": "set"}


def _counter_ops(s: SparkSession, d: str) -> DataFrame:
    op = _op(**_CT_OPS)
    return table(s, d, "events").select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("key"), op.alias("op"), F.when(op == "reset", 0).otherwise(cents()).cast("long").alias("amount"), F.col("event_id").alias("seq"))


add("counter_state", lambda s, d: st.counters(_counter_ops(s, d)), f"""WITH o AS (SELECT 'c' || CAST(user_id AS VARCHAR) AS key, {_op_sql(**_CT_OPS)} AS op, CASE WHEN event_type = 'signup' THEN 0 ELSE {CENTS_SQL} END AS amount, event_id AS seq FROM events),
 r AS (SELECT key, max(seq) AS made, arg_max(amount, seq) AS base FROM o WHERE op IN ('set', 'reset') GROUP BY key), u AS (SELECT o.key, sum(CASE op WHEN 'decr' THEN -amount ELSE amount END) AS total FROM o LEFT JOIN r ON r.key = o.key WHERE op IN ('incr', 'decr') AND (made IS NULL OR seq > made) GROUP BY o.key)
 SELECT coalesce(r.key, u.key) AS key, CAST(coalesce(base, 0) + coalesce(total, 0) AS BIGINT) AS value FROM r FULL JOIN u ON u.key = r.key""")

# --- graphs -----------------------------------------------------------------------------------------------------------------------
_GR_OPS = {"view": "add", "click": "remove", "purchase": "add", "signup": "weight", "error": "add"}


def _edge_ops(s: SparkSession, d: str) -> DataFrame:
    """Edges between users; an operation of 997 removes a node."""
    op = F.when(F.col("event_id") % 997 == 500, "remove_node").otherwise(_op(**_GR_OPS))
    weight = F.when(F.col("event_type") != "error", F.col("value"))
    return table(s, d, "events").select(F.col("user_id").alias("src"), F.when(op != "remove_node", F.col("event_id") * 31 % 40).alias("dst"), weight.alias("weight"), op.alias("op"), F.col("event_id").alias("seq"))


def _graph(s: SparkSession, d: str) -> DataFrame:
    return graph.state(_edge_ops(s, d))


_GR = f"""WITH RECURSIVE o AS (SELECT user_id AS src, event_id * 31 % 40 AS dst, CASE WHEN event_type <> 'error' THEN value END AS weight, CASE WHEN event_id % 997 = 500 THEN 'remove_node' ELSE {_op_sql(**_GR_OPS)} END AS op, event_id AS seq FROM events),
 g AS (SELECT src AS node, max(seq) AS gone FROM o WHERE op = 'remove_node' GROUP BY src), l AS (SELECT src, dst, max(seq) AS made, arg_max({{'op': op, 'w': weight}}, seq) AS x FROM o WHERE op IN ('add', 'remove') GROUP BY ALL),
 k AS (SELECT src, dst, made, x.w AS w FROM l LEFT JOIN g a ON a.node = src LEFT JOIN g b ON b.node = dst WHERE x.op = 'add' AND (a.gone IS NULL OR a.gone < made) AND (b.gone IS NULL OR b.gone < made)),
 s AS (SELECT k.src, k.dst, arg_max({{'w': o.weight}}, o.seq) AS x FROM k JOIN o ON o.src = k.src AND o.dst = k.dst WHERE o.op = 'weight' AND o.seq > k.made GROUP BY ALL),
 e AS (SELECT k.src, k.dst, CASE WHEN s.x IS NOT NULL THEN s.x.w ELSE k.w END AS weight FROM k LEFT JOIN s ON s.src = k.src AND s.dst = k.dst) """
add("graph_state", _graph, _GR + "SELECT src, dst, weight FROM e")
add("graph_edges_from", lambda s, d: _graph(s, d).where("src = 7").select("dst", "weight").orderBy("dst"), _GR + "SELECT dst, weight FROM e WHERE src = 7")
add("graph_predecessors", lambda s, d: _graph(s, d).where("dst = 7").select("src").orderBy("src"), _GR + "SELECT src FROM e WHERE dst = 7")
add("graph_weight", lambda s, d: _edge_ops(s, d).where("dst is not null").select("src", "dst").distinct().join(_graph(s, d).withColumn("x", F.lit(1)), ["src", "dst"], "left").select("src", "dst", F.col("x").isNotNull().alias("has_edge"), "weight"), _GR + "SELECT DISTINCT o.src, o.dst, e.src IS NOT NULL AS has_edge, e.weight FROM o LEFT JOIN e ON e.src = o.src AND e.dst = o.dst WHERE o.op <> 'remove_node'")
add("graph_counts", lambda s, d: _graph(s, d).agg(F.count_distinct("src").alias("nodes"), F.count(F.lit(1)).alias("edges"), (F.count_if(F.col("src") == 7) + F.count_if(F.col("dst") == 7)).alias("removed_with_7")), _GR + "SELECT count(DISTINCT src) AS nodes, count(*) AS edges, count(*) FILTER (src = 7) + count(*) FILTER (dst = 7) AS removed_with_7 FROM e")
add("graph_without_node", lambda s, d: graph.without_node(_graph(s, d), 7).select("src", "dst"), _GR + "SELECT src, dst FROM e WHERE src <> 7 AND dst <> 7")
add("graph_dfs_set", lambda s, d: graph.bfs(_graph(s, d), 7).select("node"), _GR + ", r AS (SELECT CAST(7 AS BIGINT) AS node UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r")


# --- text index -------------------------------------------------------------------------------------------------------------------
def _doc_ops(s: SparkSession, d: str) -> DataFrame:
    """Documents are added with their source as a further field; long ones are updated to their source alone, short ones removed."""
    docs = table(s, d, "documents").where("doc_id is not null")
    both = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("")))
    first = docs.select("doc_id", both.alias("text"), F.lit("add").alias("op"), F.lit(1).alias("seq"))
    longer = docs.where("n_chars > 2000").select("doc_id", F.coalesce("source", F.lit("")).alias("text"), F.lit("add").alias("op"), F.lit(2).alias("seq"))
    gone = docs.where("n_chars < 100").select("doc_id", F.lit(None).cast("string").alias("text"), F.lit("remove").alias("op"), F.lit(2).alias("seq"))
    return first.unionByName(longer).unionByName(gone)


def _index(s: SparkSession, d: str) -> DataFrame:
    return current(_doc_ops(s, d), ["doc_id"], "seq", payload=["text"])


_IX = "WITH i AS (SELECT doc_id, CASE WHEN n_chars > 2000 THEN coalesce(source, '') ELSE coalesce(text, '') || ' ' || coalesce(source, '') END AS text FROM documents WHERE doc_id IS NOT NULL AND coalesce(n_chars, 100) >= 100) "
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
add("idx_get", lambda s, d: _index(s, d).select("doc_id", F.md5("text").alias("text_md5")), _IX + "SELECT doc_id, md5(text) AS text_md5 FROM i")
add("idx_count", lambda s, d: _index(s, d).agg(F.count(F.lit(1)).alias("docs")), _IX + "SELECT count(*) AS docs FROM i")
add("idx_state", lambda s, d: text.postings(_index(s, d)).groupBy("token").agg(F.count(F.lit(1)).alias("docs")), _IX + f", p AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda w: length(w) >= 2 AND NOT list_contains([{_STOP}], w))) AS token FROM i) SELECT token, count(*) AS docs FROM p GROUP BY token")
