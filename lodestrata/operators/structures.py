"""Typed structures: time series, leaderboards, sets, multimaps, bitmaps, tries, queues."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.plans import ranged
from lodestrata.plans.folds import fold, previous, since_reset
from lodestrata.plans.scratch import Tables

CHUNK_BITS = 4096


# time series: points(series, ts_us, value); ranges are closed
def ts_range(points: DataFrame, start: int, end: int) -> DataFrame:
    return points.where((F.col("ts_us") >= start) & (F.col("ts_us") <= end))


def ts_aggregate(points: DataFrame, start: int, end: int) -> DataFrame:
    v = F.col("value").cast("decimal(18,2)")
    return ts_range(points, start, end).groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.sum(v).cast("double").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"), (F.sum(v).cast("double") / F.count(F.lit(1))).alias("mean"))


def ts_latest(points: DataFrame) -> DataFrame:
    return points.groupBy("series").agg(F.max("ts_us").alias("ts_us"), F.max_by("value", "ts_us").alias("value"))


def ts_downsample(points: DataFrame, bucket: int, start: int, end: int) -> DataFrame:
    """Buckets are counted from ``start``; empty ones are left out; integer microseconds throughout."""
    at = (F.lit(start) + F.floor((F.col("ts_us") - start) / bucket) * bucket).cast("long")
    v = F.col("value").cast("decimal(18,2)")
    return ts_range(points, start, end).groupBy("series", at.alias("bucket_us")).agg(F.count(F.lit(1)).alias("n"), F.sum(v).cast("double").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"), (F.sum(v).cast("double") / F.count(F.lit(1))).alias("mean"))


# leaderboards: scores(board, member, score); rank is by score descending, member ascending
def _by_rank(reverse: bool = False) -> Window:
    return Window.partitionBy("board").orderBy(F.asc("score") if reverse else F.desc("score"), F.desc("member") if reverse else F.asc("member"))


def lb_rank(scores: DataFrame) -> DataFrame:
    return ranged.ranked(scores, "board", "place", F.desc("score"), F.asc("member"))


def lb_top(scores: DataFrame, n: int, bottom: bool = False) -> DataFrame:
    """The first (or last, from the end) ``n`` of each board; the group limit runs before the shuffle."""
    return scores.withColumn("place", F.row_number().over(_by_rank(bottom))).where(F.col("place") <= n)


def lb_range(scores: DataFrame, low: int, high: int) -> DataFrame:
    return scores.where((F.col("score") >= low) & (F.col("score") <= high))


# sets: members(coll, member)
def coll(members: DataFrame, name: str) -> DataFrame:
    return members.where(F.col("coll") == name).select("member").distinct()


def set_relations(members: DataFrame, a: str, b: str) -> DataFrame:
    """Sizes and relations of two sets from one grouped pass."""
    side = members.where(F.col("coll").isin(a, b)).groupBy("member").agg(F.max((F.col("coll") == a).cast("int")).alias("x"), F.max((F.col("coll") == b).cast("int")).alias("y"))
    one = side.agg(F.sum("x").alias("size_a"), F.sum("y").alias("size_b"), F.sum(F.col("x") * F.col("y")).alias("both"))
    return one.select("size_a", "size_b", "both", (F.col("both") == F.col("size_a")).alias("a_subset_b"), (F.col("both") == F.col("size_b")).alias("a_superset_b"), (F.col("both") == 0).alias("disjoint"))


# multimaps: pairs(key, value)
def mm_dict(pairs: DataFrame) -> DataFrame:
    return pairs.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("value")), ",").alias("values_joined"))


def mm_items(pairs: DataFrame) -> DataFrame:
    """In the order of the encoded keys: shorter keys first."""
    return pairs.distinct().orderBy(F.char_length("key"), "key", "value")


# bitmaps: bits(name, bit)
def bitmap_count(bits: DataFrame, low: int = 0, high: int | None = None) -> DataFrame:
    found = bits.where(F.col("bit") >= low)
    found = found if high is None else found.where(F.col("bit") < high)
    bucketed = found.groupBy("name", F.expr("bitmap_bucket_number(bit)").alias("b")).agg(F.expr("bitmap_count(bitmap_construct_agg(bitmap_bit_position(bit)))").alias("n"))
    return bucketed.groupBy("name").agg(F.sum("n").alias("n_set"))


def bitmap_chunks(bits: DataFrame) -> DataFrame:
    at = F.floor(F.col("bit") / CHUNK_BITS).cast("long")
    return bits.distinct().groupBy("name", at.alias("chunk")).agg(F.count(F.lit(1)).alias("n_set"), F.min("bit").alias("first_bit"), F.max("bit").alias("last_bit"))


def bitmap_both(bits: DataFrame, a: str, b: str) -> DataFrame:
    """AND, OR and XOR of two bitmaps as counts."""
    r = set_relations(bits.select(F.col("name").alias("coll"), F.col("bit").alias("member")), a, b)
    return r.select(F.col("both").alias("n_and"), (F.col("size_a") + F.col("size_b") - F.col("both")).alias("n_or"), (F.col("size_a") + F.col("size_b") - 2 * F.col("both")).alias("n_xor"))


# tries: words(word)
def trie_search(words: DataFrame, prefix: str, limit: int) -> DataFrame:
    return words.where(F.col("word").startswith(prefix)).distinct().orderBy("word").limit(max(0, limit))


def trie_prefixes(words: DataFrame, length: int) -> DataFrame:
    return words.distinct().groupBy(F.substring("word", 1, length).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def trie_longest_prefix(words: DataFrame, texts: DataFrame) -> DataFrame:
    """For each text the longest word that it starts with; texts are matched by their prefixes, by equality."""
    tried = texts.select("text", F.explode(F.expr("transform(sequence(1, char_length(text)), i -> substring(text, 1, i))")).alias("word"))
    return tried.join(words.distinct(), "word").groupBy("text").agg(F.max_by("word", F.char_length("word")).alias("longest"))


# queues: rows(name, seq, item[, priority])
def drain(rows: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("name").orderBy("seq")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def drain_by_priority(rows: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("name").orderBy(F.desc("priority"), "seq")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


# operations on structures: ops(..., op, seq); their states
#: Points of a run of taken times that a task holds at once; a run with more is cut by ``seq`` into up to ``CHUNKS`` chunks.
HELD_POINTS, CHUNKS = 250_000, 64


def bumped(points: DataFrame) -> DataFrame:
    """Points points(series, ts_us, seq, value) added one by one: a time that is taken moves on by microseconds.

    Equally, from the first time on: of the points that have come as far as a time the earliest addition stays, the
    others move on.  Which times are taken in the end follows from counts alone; each run of them is filled by itself.
    A run of many points is cut by ``seq``: later additions never move earlier ones, so a chunk is filled around the
    times that the counts of earlier chunks take.  A point without a time stays as it is.
    """
    tables = Tables(points.sparkSession, "bumped")
    points = tables.keep(points.select("series", F.col("ts_us").cast("long").alias("ts_us"), "seq", "value"), "points")
    runs = tables.keep(_taken_runs(tables.keep(points.where("ts_us is not null").groupBy(F.struct("series").alias("of"), "ts_us").agg(F.count(F.lit(1)).alias("n")), "counts")), "runs")
    tasks = -(-(runs.agg(F.sum("n")).first()[0] or 0) // (2 * HELD_POINTS))  # else a task's sort grows with the points
    many = tables.keep(runs.groupBy("of", "run").agg(F.sum("n").alias("size")).where(F.col("size") > HELD_POINTS), "many")
    rows = points.join(runs, F.col("series").eqNullSafe(F.col("of.series")) & (points["ts_us"] == runs["ts_us"]), "left").select("series", "run", points["ts_us"], "seq", "value")
    if many.isEmpty():
        return _filled(rows.select("series", "run", F.lit(0).alias("chunk"), "ts_us", "seq", "value", F.lit(None).cast("long").alias("earlier")), tasks)
    rows = tables.keep(rows, "rows")
    many = many.select("of", F.col("run").alias("cut"), F.least(F.lit(CHUNKS), F.ceil(F.col("size") / HELD_POINTS)).cast("int").alias("chunks"))
    same = F.col("series").eqNullSafe(F.col("of.series")) & (F.col("run") == F.col("cut"))
    bounds = F.percentile_approx("seq", [i / CHUNKS for i in range(1, CHUNKS)]).alias("bounds")
    cuts = tables.keep(rows.join(F.broadcast(many), same).groupBy("of", "cut", "chunks").agg(bounds), "cuts")
    chunk = F.floor(F.size(F.filter("bounds", lambda b: b < F.col("seq"))) * F.col("chunks") / CHUNKS).cast("int")
    rows = rows.join(F.broadcast(cuts), same, "left").select("series", "run", F.when(F.col("chunks").isNull(), 0).otherwise(chunk).alias("chunk"), "ts_us", "seq", "value", "chunks")
    counts = rows.where("chunks is not null").groupBy("series", "run", "chunk", "ts_us", "chunks").agg(F.count(F.lit(1)).alias("n")).where("chunk + 1 < chunks")
    earlier = counts.select("series", "run", F.explode(F.expr("sequence(chunk + 1, chunks - 1)")).alias("chunk"), "ts_us", "n").groupBy("series", "run", "chunk", "ts_us").agg(F.sum("n").alias("earlier"))
    return _filled(rows.drop("chunks").unionByName(earlier, allowMissingColumns=True), tasks)


def _taken_runs(counts: DataFrame) -> DataFrame:
    """counts(of, ts_us, n) with ``run``: the first of the gapless times that the points at ``ts_us`` come to lie in."""
    found = ranged.running(counts, ["of"], "ts_us", "before", "sum", F.col("n"), upto=-1)
    found = found.withColumn("lead", F.col("ts_us") - F.coalesce("before", F.lit(0)))  # earlier points reach to before + the largest lead so far
    found = ranged.running(found, ["of"], "ts_us", "most", "max", F.col("lead"), upto=-1)
    first = F.when(F.col("most").isNull() | (F.col("lead") >= F.col("most")), F.col("ts_us"))
    return ranged.running(found, ["of"], "ts_us", "run", "max", first).select("of", "ts_us", "n", "run")


def _filled(rows: DataFrame, tasks: int) -> DataFrame:
    """Points rows(series, run, chunk, ts_us, seq, value, earlier) at their times, chunk by chunk, in ``tasks`` tasks at least;
    a row with ``earlier`` stands for so many points of earlier chunks, which go before all others."""
    kinds, key = dict(rows.dtypes), ("series", "run", "chunk")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, before, held, out, types = None, None, 0, [], [], None

        def give() -> Iterator[pa.RecordBatch]:
            done = [out[i : i + 50_000] for i in range(0, len(out), 50_000)]
            out.clear()
            for piece in done:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*piece, strict=True), types, strict=True)], names=["series", "ts_us", "seq", "value"])

        def place(upto: int | None) -> None:
            """Gives the times from ``at`` to ``upto`` (None: all that are needed) to those that wait."""
            nonlocal at, before
            skipped = before if upto is None else min(before, upto - at)
            before, at = before - skipped, at + skipped
            if upto is None or len(held) <= upto - at:
                out.extend((now[0], at + i, seq, value) for i, (seq, _, value) in enumerate(sorted(held)))
                held.clear()
            else:
                for i in range(upto - at):
                    seq, _, value = heapq.heappop(held)
                    out.append((now[0], at + i, seq, value))

        n = 0
        for batch in batches:
            types = [batch.schema.field(i).type for i in (0, 3, 4, 5)]
            for series, run, chunk, ts, seq, value, earlier in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ts is None:
                    out.append((series, None, seq, value))
                    continue
                if (series, run, chunk) != now:
                    if now is not None:
                        place(None)
                    now, at, before = (series, run, chunk), ts, 0
                elif ts != at:
                    place(ts)
                    at = ts
                if earlier is not None:
                    before += earlier
                else:
                    n += 1
                    heapq.heappush(held, (seq, n, value))
                if len(out) >= 50_000:
                    yield from give()
            yield from give()
        if now is not None:
            place(None)
        yield from give()

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("series", "ts_us", "seq", "value"))
    few = tasks <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(*key) if few else rows.repartition(tasks, *key)
    return dealt.sortWithinPartitions(*key, "ts_us").mapInArrow(fill, schema)


def added_together(points: DataFrame) -> DataFrame:
    """Points of one batch: of those at the same time the last is kept."""
    return points.groupBy("series", "ts_us").agg(F.max_by("value", "seq").alias("value"))


def ts_first(points: DataFrame) -> DataFrame:
    return points.groupBy("series").agg(F.min("ts_us").alias("ts_us"), F.min_by("value", "ts_us").alias("value"))


def ts_newest(points: DataFrame, n: int) -> DataFrame:
    """The last ``n`` points of each series, oldest first."""
    order = Window.partitionBy("series").orderBy(F.desc("ts_us"))
    return points.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r").orderBy("series", "ts_us")


def scores(ops: DataFrame) -> DataFrame:
    """Leaderboard after ops(board, member, op, amount, seq): add sets, update adds (absent counts as 0), remove deletes,
    clear (member null) empties the board."""
    wiped = ops.where("op = 'clear'").groupBy("board").agg(F.max("seq").alias("wiped"))
    rows = ops.where("op <> 'clear'").join(wiped, "board", "left").where("wiped is null or wiped < seq")
    reset = F.col("op").isin("add", "remove")
    state = since_reset(rows, ["board", "member"], "seq", reset, F.when(F.col("op") == "add", F.col("amount")), F.col("amount"))
    return state.where("base is not null or n > 0").select("board", "member", (F.coalesce("base", F.lit(0)) + F.col("total")).cast("long").alias("score"))


def counters(ops: DataFrame) -> DataFrame:
    """Counters after ops(key, op, amount, seq): incr and decr add, set and reset give a value."""
    delta = F.when(F.col("op") == "decr", -F.col("amount")).otherwise(F.col("amount"))
    state = since_reset(ops, ["key"], "seq", F.col("op").isin("set", "reset"), F.col("amount"), delta)
    return state.select("key", (F.coalesce("base", F.lit(0)) + F.col("total")).cast("long").alias("value"))


def bits_after(ops: DataFrame) -> DataFrame:
    """Set bits (name, bit) after ops(name, low, high, op, seq) on ranges [low, high): set, clear, toggle."""
    each = ops.where("high > low").withColumn("bit", F.explode(F.sequence("low", F.col("high") - 1)))
    state = since_reset(each, ["name", "bit"], "seq", F.col("op") != "toggle", (F.col("op") == "set").cast("int"), F.lit(1))
    return state.where((F.coalesce("base", F.lit(0)) + F.col("total")) % 2 == 1).select("name", "bit")


def news(ops: DataFrame, item: list[str], scope: list[str]) -> DataFrame:
    """How many additions of ops(item..., op, seq) were new and how many removals found their item, by scope."""
    seen = previous(ops, item, "seq", "op")
    there = F.coalesce(F.col("before") == "add", F.lit(False))
    return seen.groupBy(*scope).agg(F.count_if((F.col("op") == "add") & ~there).alias("added"), F.count_if((F.col("op") == "remove") & there).alias("removed"))


def queue_after(ops: DataFrame) -> DataFrame:
    """Queues after ops(name, seq, op, item), push or pop, in order: the items that are left, from the head on.

    A pop of an empty queue takes nothing: with s the pushes less the pops so far and m the least s so far (0 at most),
    m pops were in vain, so as many items are gone as there were pops less those.
    """
    pushes = F.col("op") == "push"
    level = ranged.running(ops, ["name"], "seq", "s", "sum", F.when(pushes, 1).otherwise(-1))
    taken = level.groupBy("name").agg((F.count_if(~pushes) + F.least(F.min("s"), F.lit(0))).alias("taken"))
    pushed = ranged.running(ops.where(pushes), ["name"], "seq", "place", "sum", F.lit(1))
    return pushed.join(taken, "name").where("place > taken").select("name", (F.col("place") - F.col("taken")).cast("int").alias("place"), "seq", "item")


def queue_pops(ops: DataFrame) -> DataFrame:
    """What each pop of ops(name, seq, op, item) took: null from an empty queue."""
    pushes = F.col("op") == "push"
    level = ranged.running(ops, ["name"], "seq", "s", "sum", F.when(pushes, 1).otherwise(-1))
    level = ranged.running(level, ["name"], "seq", "least", "min", F.col("s"), upto=-1)
    level = ranged.running(level, ["name"], "seq", "pops", "sum", F.when(pushes, 0).otherwise(1))
    least = F.least(F.coalesce("least", F.lit(0)), F.lit(0))
    pops = level.where(~pushes).withColumn("place", F.when(F.col("s") >= least, F.col("pops") + least))
    pushed = ranged.running(ops.where(pushes), ["name"], "seq", "place", "sum", F.lit(1)).select("name", "place", "item")
    return pops.select("name", "seq", "place").join(pushed, ["name", "place"], "left").select("name", "seq", "item")


def priority_pops(ops: DataFrame) -> DataFrame:
    """What each pop of ops(name, seq, op, priority) took: the seq of the push, highest priority first, then the earliest."""

    def step(heap, seq, op, priority):
        if op == "push":
            heapq.heappush(heap, (-priority, seq))
            return heap, (None,)
        return heap, (heapq.heappop(heap)[1] if heap else None,)

    rows = ops.select("name", "seq", F.col("seq").alias("own"), "op", "priority")
    return fold(rows, "name", ("seq",), ("own", "op", "priority"), list, step, every="taken bigint").join(ops.where("op = 'pop'").select("name", "seq"), ["name", "seq"], "left_semi")
