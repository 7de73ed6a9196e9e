"""Ordered logic against plain Python, decided quirks, skewed keys, files and streams."""

from __future__ import annotations

import heapq
import os
import random
import re
from collections import defaultdict, deque

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestrata import catalogue
from lodestrata.functions import metrics, sketch
from lodestrata.operators import graph, manifest, rmw, scan, text, txn
from lodestrata.operators import structures as st
from lodestrata.plans import folds, ranged, view
from lodestrata.plans import log as kv
from lodestrata.plans.scratch import Tables
from lodestrata.sources import jsonl
from lodestrata.store import Namespace, Store, float_text
from lodestrata.streaming import live as streams

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
LOG = "seq long, ord int, key string, op string, value string, expires_at long"


def log_of(spark, *ops):
    """Commits of (key, value[, expires_at]); a value of None deletes."""
    return spark.createDataFrame([(i, 0, o[0], "D" if o[1] is None else "P", o[1], o[2] if len(o) > 2 else None) for i, o in enumerate(ops, 1)], LOG)


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def events():
    t = pq.read_table(f"{DATA}/events.parquet", columns=["event_id", "user_id", "event_type", "value"]).to_pylist()
    return sorted(t, key=lambda r: r["event_id"])


# --- ordered logic ------------------------------------------------------------------------------------------------------------


def test_points_are_bumped_in_order(spark):
    taken, want = defaultdict(set), []
    for r in events():
        at = r["event_id"] * 7919 % 3001
        while at in taken[r["event_type"]]:
            at += 1
        taken[r["event_type"]].add(at)
        want.append((r["event_type"], at, r["event_id"], r["value"]))
    got = catalogue.queries()["ts_add_cascading"](spark, DATA).select("series", "ts_us", "seq", "value")
    assert pairs(got) == sorted(want)


def bumped_one_by_one(points):
    taken, out = defaultdict(set), []
    for series, at, seq, value in sorted(points, key=lambda p: p[2]):
        while at in taken[series]:
            at += 1
        taken[series].add(at)
        out.append((series, at, seq, value))
    return sorted(map(repr, out))


def bumped_by_engine(spark, points):
    df = spark.createDataFrame(points, "series string, ts_us long, seq long, value double")
    return sorted(repr(tuple(r)) for r in st.bumped(df).select("series", "ts_us", "seq", "value").collect())


def test_points_are_bumped_in_few_jobs(spark):
    """Points that are crowded into a few times do not move on round by round."""
    points = [("s", seq * 7919 % 41, seq, float(seq)) for seq in range(3000)]
    spark.sparkContext.setJobGroup("bumped", "bumped")
    assert bumped_by_engine(spark, points) == bumped_one_by_one(points)
    spark.sparkContext._jsc.clearJobGroup()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("bumped")) < 60


@pytest.mark.parametrize("held", [3, 40, 100_000])
def test_points_are_bumped_in_chunks(spark, monkeypatch, held):
    """Runs of every length, next to each other and apart, cut by seq or whole; no series, no time, negative times."""
    monkeypatch.setattr(st, "HELD_POINTS", held)
    rng = random.Random(held)
    seqs = rng.sample(range(10**9), 1500)
    points = [(rng.choice("ab"), rng.choice((rng.randrange(-300, 300), 5, rng.randrange(10**6))), seq, float(seq % 7)) for seq in seqs[:1200]]
    points += [(None, rng.randrange(50), seq, None) for seq in seqs[1200:1450]] + [(rng.choice("ab"), None, seq, 1.0) for seq in seqs[1450:]]
    got = bumped_by_engine(spark, points)
    timed = [p for p in points if p[1] is not None]
    assert got == sorted(bumped_one_by_one(timed) + [repr(p) for p in points if p[1] is None])


def test_queues_pop_in_order(spark):
    queue, heap, taken, best = defaultdict(deque), defaultdict(list), [], []
    for r in events():
        name, seq = r["user_id"] % 12, r["event_id"]
        if r["event_type"] in ("click", "error"):
            taken.append((name, seq, queue[name].popleft() if queue[name] else None))
            best.append((name, seq, heapq.heappop(heap[name])[1] if heap[name] else None))
        else:
            queue[name].append(r["event_type"])
            heapq.heappush(heap[name], (-int(r["value"]), seq))
    q = catalogue.queries()
    assert sorted(map(repr, taken)) == sorted(repr(tuple(r)) for r in q["queue_pop"](spark, DATA).select("name", "seq", "item").collect())
    assert sorted(map(repr, best)) == sorted(repr(tuple(r)) for r in q["pq_pop"](spark, DATA).select("name", "seq", "taken").collect())
    left = [(n, i + 1, x) for n, items in queue.items() for i, x in enumerate(items)]
    assert pairs(q["queue_state"](spark, DATA).select("name", "place", "item")) == sorted(left)


def serial(reads, writes, state):
    """Transactions one after the other: numbers of those that commit, and the state after them."""
    out = {}
    for t in sorted({t for t, _, _ in reads} | {t for t, _, _, _ in writes}):
        out[t] = all(state.get(k) == seen for x, k, seen in reads if x == t)
        if out[t]:
            for x, k, op, v in writes:
                if x == t:
                    if op == "P":
                        state[k] = v
                    else:
                        state.pop(k, None)
    return out, state


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_transactions_commit_in_order(spark, seed):
    rng = random.Random(seed)
    keys = [f"k{i}" for i in range(8)]
    state = {k: str(rng.randint(0, 1)) for k in keys[:5]}
    reads, writes = [], []
    for t in range(14):
        reads += [(t, k, state.get(k) if rng.random() < 0.8 else "0") for k in rng.sample(keys, rng.randint(0, 3))]
        writes += [(t, k, *(("D", None) if rng.random() < 0.3 else ("P", str(rng.randint(0, 1))))) for k in rng.sample(keys, rng.randint(0, 2))]
    live = spark.createDataFrame(list(state.items()), "key string, value string")
    want, after = serial(reads, writes, dict(state))
    got = txn.commit(spark.createDataFrame(reads, "txn long, key string, seen string"), spark.createDataFrame(writes, "txn long, key string, op string, value string"), live)
    assert {r["txn"]: r["commits"] for r in got.collect()} == want
    store = Store(log_of(spark, *state.items()), 0)
    batch = txn.committed_writes(spark.createDataFrame(writes, "txn long, key string, op string, value string"), got)
    assert dict(pairs(store.state(batch).select("key", "value"))) == after


def test_transaction_queries(spark):
    q = catalogue.queries()
    from lodestrata.queries.store import _transactions

    reads, writes, store = _transactions(spark, DATA)
    state = dict(pairs(store.live.select("key", "value")))
    want, after = serial([tuple(r) for r in reads.collect()], [tuple(r) for r in writes.select("txn", "key", "op", "value").collect()], state)
    assert {r["txn"]: r["commits"] for r in q["txn_commit"](spark, DATA).collect()} == want and {True, False} <= set(want.values())
    assert dict(pairs(q["txn_apply"](spark, DATA).select("key", "value"))) == after


def test_locks(spark):
    """A lock is not re-entrant; unlock and extend need the holder; an expired lock is free."""
    asked = [("a", 1, "lock", 1, 0), ("a", 2, "lock", 1, 5), ("a", 3, "unlock", 2, 6), ("a", 4, "extend", 1, 7), ("a", 5, "lock", 2, 16), ("a", 6, "lock", 2, 18), ("a", 7, "unlock", 2, 19), ("b", 1, "unlock", 1, 0)]
    out = rmw.lock_fold(spark.createDataFrame(asked, "name string, seq long, action string, owner long, ts_us long"), 10, 10)
    assert pairs(out.select("name", "locks", "unlocks", "extends")) == [("a", 2, 1, 1), ("b", 0, 0, 0)]
    assert out.where("name = 'a'").first()["owner"] is None


def test_refused_puts_change_nothing(spark):
    ops = [("k", 1, "XX", "a", None, 1), ("k", 2, "NX", "b", 10, 2), ("k", 3, "NX", "c", None, 3), ("k", 4, "XX", "d", 20, 9), ("k", 5, "XX", "e", None, 20), ("k", 6, "NX", "f", None, 21), ("k", 7, "D", None, None, 22), ("k", 8, "XX", "g", None, 23)]
    out = rmw.conditional(spark.createDataFrame(ops, "key string, seq long, mode string, value string, expires_at long, ts_us long"))
    assert [r["applied"] for r in out.orderBy("seq").collect()] == [False, True, False, True, False, True, True, False]


# --- skewed keys and global orders --------------------------------------------------------------------------------------------


def test_one_hot_key(spark):
    """Folds, appends and resets of a key with most rows, in any number of partitions."""
    rows = [("hot", i, 0, "P", str(i % 10)) for i in range(20_000)] + [(f"k{i}", i, 0, "P", "x") for i in range(50)]
    log = spark.createDataFrame(rows, "key string, seq long, ord int, op string, value string").repartition(16)
    out = {r["key"]: r["value"] for r in rmw.appended(log, span=512).collect()}
    assert out["hot"] == ",".join(str(i % 10) for i in range(20_000)) and out["k7"] == "x"
    swaps = rmw.cas_fold(log.select("seq", "key", F.when(F.col("seq") % 10 > 0, ((F.col("seq") - 1) % 10).cast("string")).alias("expected"), "value")).where("key = 'hot'").first()
    assert (swaps["value"], swaps["swaps"]) == ("9", 10)  # then nothing is absent any more
    total = folds.since_reset(log.withColumn("amount", F.lit(1)), ["key"], "seq", F.col("seq") == 5000, F.lit(7), F.col("amount"))
    assert {r["key"]: (r["base"], r["total"]) for r in total.collect()}["hot"] == (7, 14_999)


def test_ranged_orders(spark):
    """Positions, next keys and nearest keys across the borders of ranges, with a common prefix of all keys."""
    keys = [f"one:long:common:prefix:{i:05d}" for i in range(0, 3000, 3)]
    df = spark.createDataFrame([(k,) for k in keys], "key string").repartition(7)
    assert pairs(ranged.numbered(df, "key").select("position", "key")) == list(enumerate(keys))
    assert pairs(ranged.with_next(df, "key").where("next_key is not null")) == list(zip(keys, keys[1:]))
    probes = [keys[0][:-5] + f"{i:05d}" for i in range(0, 3100, 7)] + ["a", "z"]
    got = {r["probe"]: (r["floor_key"], r["ceiling_key"]) for r in scan.floor_ceiling(spark.createDataFrame([(p,) for p in probes], "probe string"), df).collect()}
    for p in probes:
        assert got[p] == (max((k for k in keys if k <= p), default=None), min((k for k in keys if k >= p), default=None))
    assert scan.is_empty(df.where("false")).first()[0] and not scan.is_empty(df).first()[0]


def test_hot_keys_are_cut_into_spans(spark, monkeypatch):
    """With small spans the same rows as with one window a key: lags, running values, ranks, queues."""
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 9)}", i * 3, rng.choice(["push", "pop"]), rng.choice([None, *range(9)])) for i in range(600)]
    df = spark.createDataFrame(rows, "name string, seq long, op string, item long").repartition(5)

    def all_of():
        out = [pairs_(ranged.lagged(df, ["name"], "seq", "old", "item"))]
        out += [pairs_(ranged.running(df, ["name"], "seq", "x", how, F.col("item"), upto)) for how in ("sum", "min", "max") for upto in (0, -1)]
        out += [pairs_(ranged.ranked(df, "name", "r", F.desc("item"), F.asc("seq"))), pairs_(st.queue_after(df)), pairs_(st.queue_pops(df))]
        return out

    def pairs_(x):
        return sorted(repr({c: r[c] for c in sorted(x.columns)}) for r in x.collect())

    want = all_of()
    monkeypatch.setattr(ranged, "HOT_ROWS", 16)
    assert all_of() == want


def test_overlapping_files(spark):
    rng = random.Random(5)

    def files(n, base):
        cut = [sorted(rng.sample(range(1000), 2)) for _ in range(n)]
        return [(base + i, f"{a:04d}", f"{min(b, a + 30):04d}", 1, 0) for i, (a, b) in enumerate(cut)]

    left, right = files(60, 0), files(8, 100)
    schema = "file long, first_key string, last_key string, bytes long, level int"
    got = manifest.overlapping(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    assert sorted(r["file"] for r in got.collect()) == sorted(f for f, a, b, _, _ in left if any(c <= b and e >= a for _, c, e, _, _ in right))


# --- decided quirks -----------------------------------------------------------------------------------------------------------


def test_newest_version_wins_in_compaction(spark):
    log = log_of(spark, ("a", "1"), ("b", "1"), ("a", "2"), ("b", None))
    assert pairs(kv.compact(log, 0).select("key", "value")) == [("a", "2")]
    assert pairs(kv.compact(log, 0, drop_deletes=False).select("key", "op")) == [("a", "P"), ("b", "D")]


def test_expired_or_deleted_versions_do_not_come_back(spark):
    store = Store(log_of(spark, ("a", "old"), ("a", "new", 50), ("b", "x"), ("b", None), ("c", "y", 200)), 100)
    assert pairs(store.live.select("key", "value")) == [("c", "y")]
    kinds = store.key_type(spark.createDataFrame([(k,) for k in "abcd"], "key string"))
    assert dict(pairs(kinds)) == {"a": "expired", "b": "none", "c": "string", "d": "none"}


def test_snapshots_keep_what_was_there(spark):
    store = Store(log_of(spark, ("a", "1"), ("b", "1"), ("a", None), ("b", "2")), 0)
    assert pairs(store.snapshot(2).scan()) == [("a", "1"), ("b", "1")] and pairs(store.scan()) == [("b", "2")]


def test_bounds_limits_and_prefixes(spark):
    store = Store(log_of(spark, ("a", "1"), ("b", "2"), ("ÿ", "3"), ("c\x7f", "4"), ("c\x7fd", "5")), 0)
    assert store.scan("", "").count() == 5 and store.scan(limit=0).count() == 0 and store.tail(0).count() == 0
    assert pairs(store.prefix_scan("c\x7f").select("value")) == [("4",), ("5",)] and pairs(store.prefix_scan("ÿ").select("value")) == [("3",)]
    words = spark.createDataFrame([("b",), ("a",)], "word string")
    assert st.trie_search(words, "", 0).count() == 0


def test_zero_time_to_live(spark):
    """Permanent in put and touch, expired in put_ttl and touch_many; rewriting drops it; a past time is a millisecond away."""
    store = Store(log_of(spark, ("a", "1", 500)), 100)
    key = spark.createDataFrame([("a",)], "key string")
    rows = spark.createDataFrame([("a", "2")], "key string, value string")
    assert pairs(store.state(store.put(rows, 0))) == [("a", "2", None)] and pairs(store.state(store.touch(key, 0))) == [("a", "1", None)]
    assert pairs(store.state(store.put_ttl(rows, 0))) == [] and pairs(store.state(store.touch_many(key, 0))) == []
    assert pairs(store.state(store.map_values(F.concat("value", F.lit("!"))))) == [("a", "1!", None)]
    times = spark.createDataFrame([("a", 5)], "key string, at_us long")
    assert pairs(store.state(store.expireat(times))) == [("a", "1", 1100)]


def test_namespaces_stay_within_their_prefix(spark):
    store = Store(log_of(spark, ("u:a", "1"), ("u:b", "2"), ("u;c", "3"), ("v:a", "4")), 0)
    ns = Namespace(store, "u:")
    assert ns.prefix == "u:" and Namespace(store, "u").prefix == "u:" and Namespace(store, "").prefix == ""
    assert pairs(ns.scan()) == [("a", "1"), ("b", "2")] and pairs(ns.tail(5)) == [("a", "1"), ("b", "2")]
    assert pairs(ns.state(ns.range_delete("b")).select("key")) == [("u:a",), ("u;c",), ("v:a",)]
    assert pairs(ns.state(ns.map_values(F.lit("x"))).select("key", "value")) == [("u:a", "x"), ("u:b", "x"), ("u;c", "3"), ("v:a", "4")]


def test_rename_reads_all_values_first(spark):
    store = Store(log_of(spark, ("a", "1"), ("b", "2"), ("c", "3")), 0)
    names = spark.createDataFrame([("a", "b"), ("b", "a"), ("x", "y"), ("c", "d")], "key string, new_key string")
    assert pairs(store.state(store.rename(names)).select("key", "value")) == [("a", "2"), ("b", "1"), ("d", "3")]


def test_collections_count_new_members_once(spark):
    ops = [("c", "m", "add", 1), ("c", "m", "add", 2), ("c", "n", "remove", 3), ("c", "m", "remove", 4), ("c", "m", "add", 5)]
    out = st.news(spark.createDataFrame(ops, "coll string, member string, op string, seq long"), ["coll", "member"], ["coll"]).first()
    assert (out["added"], out["removed"]) == (2, 1)


def test_names_with_colons(spark):
    edges = spark.createDataFrame([("a", "x", 1.0, "add", 1), ("a:b", "y", None, "add", 2), ("a", "a", 2.0, "add", 3)], "src string, dst string, weight double, op string, seq long")
    state = graph.state(edges)
    assert pairs(state.where("src = 'a'").select("dst")) == [("a",), ("x",)]
    assert graph.without_node(state, "a").count() == 1


def test_floats_as_text(spark):
    values = [0.0, 1.0, -2.5, 0.1 + 0.2, 12345678.0, 1234567890.125, 0.0005, 0.00012, 9999999.0, 1e7, 123456789012345.6]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(float_text(F.col("x"))).collect()]
    assert got == [repr(v) for v in values]


def test_unknown_export_format(spark):
    with pytest.raises(ValueError, match="unknown format"):
        Store(log_of(spark, ("a", "1")), 0).export("/nowhere", form="csv")


# --- files, sketches, metrics, streams ----------------------------------------------------------------------------------------


def test_lines_and_backups(spark):
    nasty = [("a", 'quote " and \\'), ("b\n", "line\nbreak"), ("cé", ""), ("d", "\u0001")]
    path = f"{Tables(spark, 'test').path}"
    store = Store(log_of(spark, *nasty, ("gone", "x"), ("gone", None)), 0)
    assert store.export(f"{path}/lines") == 4
    assert pairs(jsonl.read(spark, f"{path}/lines")) == sorted(nasty)
    got = jsonl.backup(store.log, f"{path}/copy")
    assert got["files"] >= 1 and got["bytes"] > 0
    assert pairs(Store(jsonl.restore(spark, f"{path}/copy"), 0).scan()) == sorted(nasty)


def test_written_view(spark):
    """A view gives the live keys, prunes by key, and is carried on by later commits."""
    path = f"{Tables(spark, 'test').path}/view"
    log = log_of(spark, *[(f"k{i % 500:04d}", None if i % 7 == 0 else str(i)) for i in range(2000)])
    view.write(kv.latest(log.where("seq <= 1500")), path)
    assert pairs(view.read(spark, path, 0).drop("seq")) == pairs(kv.live(log.where("seq <= 1500"), 0).drop("seq"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = view.read(spark, path, 0).where("key = 'k0100'")._jdf.queryExecution().toString()
    assert "EqualTo(key,k0100)" in plan
    view.write(view.refreshed(spark, path, log.where("seq > 1500")), f"{path}2")
    assert pairs(view.read(spark, f"{path}2", 0)) == pairs(kv.live(log, 0))


def test_replay_stops_at_the_first_bad_record(spark):
    log = log_of(spark, ("a", "1"), ("b", None), ("c", "3"), ("d", "4"))
    bad = kv.record(log).withColumn("crc", F.when(F.col("seq") == 3, 0).otherwise(F.col("crc")))
    assert pairs(kv.replay(bad).select("seq", "op", "key", "value")) == [(1, "P", "a", "1"), (2, "D", "b", None)]
    assert kv.replay(kv.record(log)).count() == 4


def test_bloom_bits_as_hashed_in_python(spark):
    import hashlib

    items = [f"item{i}" for i in range(50)]
    for bits, hashes in ((997, 7), ((1 << 31) + 11, 5), ((1 << 40) + 3, 3)):
        want = set()
        for x in items:
            raw = hashlib.sha256(x.encode()).digest()
            one, two = int.from_bytes(raw[:8], "big"), int.from_bytes(raw[8:16], "big")
            want |= {(one + i * two) % bits for i in range(hashes)}
        got = sketch.bloom_bits(spark.createDataFrame([(x,) for x in items], "item string"), "item", bits, hashes)
        assert {r["bit"] for r in got.collect()} == want
    assert sketch.bloom_size(1000, 0.01) == (9586, 7)


def test_registers_as_hashed_in_python(spark):
    import hashlib

    items = [("s", f"user:{i}") for i in range(3000)]
    want = {}
    for _, x in items:
        h = int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "big")
        want[h & 511] = max(want.get(h & 511, 0), 55 - (h >> 9).bit_length() + 1)
    regs = sketch.registers(spark.createDataFrame(items, "name string, item string"), "name", "item")
    assert {r["bucket"]: r["rho"] for r in regs.collect()} == want
    one, two = (sketch.registers(spark.createDataFrame(items[a:b], "name string, item string"), "name", "item") for a, b in ((0, 2000), (1000, 3000)))
    assert pairs(sketch.merge(one.union(two), "s")) == pairs(regs)
    assert abs(sketch.estimate(regs).first()["estimate"] - 3000) < 450


def test_histogram_overflows_to_infinity(spark):
    rows = spark.createDataFrame([("g", float(x)) for x in [1, 2, 3, 100_000, 100_001, 10**9]], "g string, v double")
    hist = metrics.histogram(rows, "g", "v")
    assert dict(pairs(hist.select("upper", "n"))) == {1.0: 1, 2.0: 1, 5.0: 1, 100_000.0: 1, float("inf"): 2}
    assert {r["percent"]: r["p_upper"] for r in metrics.percentiles(hist, 50, 99).collect()} == {50.0: 5.0, 99.0: float("inf")}


def test_search_ties(spark):
    docs = spark.createDataFrame([(1, "beta"), (2, "alpha"), (3, "alpha"), (4, "it's beta alpha"), (5, "a the of")], "doc_id long, text string")
    out = text.search(docs, spark.createDataFrame([(0, "Alpha beta beta the"), (1, "a"), (2, None)], "query_id long, text string"), 10)
    assert [r["doc_id"] for r in out.orderBy("place").collect()] == [4, 1, 2, 3]
    assert pairs(text.postings(docs).where("doc_id = 4").select("token")) == [("alpha",), ("beta",), ("it's",)]


def best_by_brute_force(docs, queries, n):
    held, asked = defaultdict(set), defaultdict(list)
    for i, x in docs:
        held[i] |= set((x or "").split())
    for q, x in queries:
        asked[q] += enumerate((x or "").split())
    out = []
    for q, words in asked.items():
        hits = {i: [k for k, w in words if w in has] for i, has in held.items()}
        order = sorted((i for i in hits if hits[i]), key=lambda i: (-len(hits[i]), min(hits[i]), i is None, i or 0))
        out += [(q, i, len(hits[i]), place) for place, i in enumerate(order[:n], 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize(("matches", "asked", "n"), [(1_000_000, 500_000, 3), (50, 500_000, 1), (7, 40, 3), (1, 1_000, 100)])
def test_search_in_pieces(spark, monkeypatch, matches, asked, n):
    """A word of almost every text, rare words, repeated and missing ids and texts; few matches a piece, queries in parts."""
    monkeypatch.setattr(text, "MATCHES", matches, raising=False)
    monkeypatch.setattr(text, "BROADCAST_TOKENS", asked)
    rng = random.Random(n)

    def words(k):
        return " ".join(rng.choice(("often", f"w{rng.randrange(9)}", f"rare{rng.randrange(400)}")) for _ in range(k))

    docs = [(rng.choice((i, i, i, 7, None)), rng.choice((words(12), words(1), "", None))) for i in range(400)]
    queries = [(q % 55, rng.choice((words(6), words(1), f"rare{q}", "nowhere", None))) for q in range(60)]
    found = text.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(queries, "query_id int, text string"), n)
    assert found.dtypes == [("query_id", "int"), ("doc_id", "bigint"), ("score", "bigint"), ("place", "int")]
    assert sorted(repr(tuple(r)) for r in found.collect()) == best_by_brute_force(docs, queries, n)


def test_search_of_nothing(spark):
    none, one = spark.createDataFrame([], "doc_id string, text string"), spark.createDataFrame([("a", "word")], "doc_id string, text string")
    ask = one.withColumnRenamed("doc_id", "query_id")
    assert text.search(none, ask, 5).count() == text.search(one, ask.where("false"), 5).count() == 0
    assert pairs(text.search(one, ask, 5)) == [("a", "a", 1, 1)]


def test_search_sends_its_best_only(spark):
    """No table of all matching pairs of query and document is dealt out or held."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('often w', id % 50) AS text").repartition(4)
    queries = spark.range(50).selectExpr("id AS query_id", "concat('often w', id) AS text")
    out = text.search(docs, queries, 2)
    assert pairs(out.where("query_id = 7")) == [(7, 7, 2, 1), (7, 57, 2, 2)]
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", out._jdf.queryExecution().executedPlan().toString())


def test_streams(spark, tmp_path):
    """Changes that arrive in files give the newest versions, and windows drop late rows."""
    folder, point = str(tmp_path / "log"), str(tmp_path / "check")
    log_of(spark, ("a", "1"), ("b", "1")).write.parquet(folder)
    stream = streams.latest(streams.changes(spark, folder))
    query = stream.writeStream.format("memory").queryName("newest").outputMode("complete").option("checkpointLocation", point).start()
    query.processAllAvailable()
    spark.createDataFrame([(5, 0, "a", "D", None, None), (6, 0, "c", "P", "3", None)], LOG).write.mode("append").parquet(folder)
    query.processAllAvailable()
    query.stop()
    assert pairs(spark.table("newest").select("key", "op")) == [("a", "D"), ("b", "P"), ("c", "P")]
    points, out = str(tmp_path / "points"), str(tmp_path / "out")
    schema = "ts timestamp, series string, value double"
    spark.sql("SELECT timestamp'2024-01-01 00:00:10' AS ts, 's' AS series, 1D AS value UNION ALL SELECT timestamp'2024-01-01 01:00:00', 's', 5D").write.parquet(points)
    counts = streams.windowed(spark.readStream.schema(schema).parquet(points), "1 minute", "5 minutes")
    query = counts.writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", str(tmp_path / "check2")).start()
    query.processAllAvailable()
    spark.sql("SELECT timestamp'2024-01-01 00:00:20' AS ts, 's' AS series, 9D AS value UNION ALL SELECT timestamp'2024-01-01 02:00:00', 's', 7D").write.mode("append").parquet(points)
    query.processAllAvailable()
    query.stop()
    done = spark.read.parquet(out).select(F.date_format("window.start", "HH:mm").alias("at"), "n", "high")
    assert pairs(done) == [("00:00", 1, 1.0), ("01:00", 1, 5.0)]
