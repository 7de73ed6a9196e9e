"""Near-duplicate classes: a chosen-path set similarity join over word shingles, confirmed on full sets.

1.  Every document becomes its set of distinct shingles (64-bit hashes).  A one-pass minwise signature of it, a
    128-bit sketch of that signature and a digest of the set are kept, not the set.  Equal sets become one
    representative (the smallest doc_id), so exact copies cost nothing from here on.
2.  Chosen paths: in each of several independent trees a node (a path of minwise tokens) selects one coordinate or,
    a quarter of the time, two (1 / threshold on average); a document goes on to the node of its own minwise value
    there.  The first levels need no other document and are done in place.  Then nodes are looked at: a small one is
    compared exhaustively by sketch; the documents of a large one branch again; documents that still share a large
    node at the last level agree on so many tokens that they are taken as candidates of one another, each through
    the first.  The number of trees follows from the chance that a pair at the threshold misses all.
3.  Candidate pairs form clusters.  Each cluster's full sets meet in one bounded task, which finds its exact classes:
    a document's intersections with all others come from the shingles' postings, and documents outside the largest
    class are each compared with everything, so no link between two classes is missed.
    A cluster whose sets exceed ``block_shingles`` is cut into blocks: all blocks first meet some common pivots; then
    every document outside the cluster's largest class meets every block.

Defined cases: a text without words (or null) has no shingles and is linked with nothing; with fewer words than a
shingle has, the whole sequence is the only shingle; rows with a null doc_id get a null component and are kept; rows
that repeat a doc_id stay, each with its own n_shingles (if their texts differ, all sets that have the id as their
smallest count as that document, so what is linked with any of them is in its class); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textvec as tv
from lodestrata.llm.components import components
from lodestrata.llm.runtime import Scratch, ship

COORDINATES = 128
BRANCH_TWO = 0.25  # a node selects two coordinates so often, else one: 1 / 0.8 on average
MISS = 1e-6
LEAF = 32
STRANGERS = 25
LEVELS_MORE = 1
BLOCK_SHINGLES = 2_000_000
PIVOTS = 16
BROADCAST_IDS = 300_000
#: Sets that a task remembers having given, so that repeated rows are not sent again.
GIVEN = 200_000
_U = np.uint64


# --- sets and signatures --------------------------------------------------------------------------------------------


def sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingles of all rows, row bounds) for chunks of a string column."""
    for first, data, offs in tv.chunks(column):
        data = tv.lower_ascii(data)
        starts, ends, at = tv.words(data, offs)
        yield first, *tv.distinct_sorted(*tv.shingles(tv.hash_spans(data, starts, ends), at, k))


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One-permutation minwise values (rows x COORDINATES, 32 bits); a coordinate without a shingle borrows another's.

    Which one it borrows depends on the coordinate alone, so equal sets, and similar ones mostly, borrow alike.
    """
    rows, t = len(at) - 1, COORDINATES
    row = np.repeat(np.arange(rows), np.diff(at))
    spread = tv.mix(values ^ _U(0xA5A5A5A5DEADBEEF))
    place = row * t + (spread >> _U(57)).astype(np.int64)
    value = (spread & _U(0xFFFFFFFF)).astype(np.uint32)
    out = np.full(rows * t, 0xFFFFFFFF, dtype=np.uint32)
    np.minimum.at(out, place, value)
    full = np.zeros(rows * t, dtype=bool)
    full[place] = True
    out, full = out.reshape(rows, t), full.reshape(rows, t)
    some = np.diff(at) > 0
    for attempt in range(1, 400):
        lack = ~full & some[:, None] if attempt == 1 else lack
        r, c = np.nonzero(lack)
        if not len(r):
            break
        if attempt < 200:
            source = (tv.mix(np.arange(t, dtype=np.uint64) * _U(1000) + _U(attempt)) % _U(t)).astype(np.int64)[c]
        else:
            source = (c + attempt) % t
        ok = full[r, source]
        out[r[ok], c[ok]] = out[r[ok], source[ok]]
        lack[r[ok], c[ok]] = False
    return out


def sketches(signature: np.ndarray) -> np.ndarray:
    """One bit a coordinate: two unsigned 64-bit numbers a row."""
    bit = (tv.mix(signature.astype(np.uint64) + np.arange(COORDINATES, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(40)) & _U(1)
    return np.packbits(bit.astype(np.uint8), axis=1).view("<u8").reshape(-1, 2)


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, values, at in sets(batch.column(1), k):
                rows = len(at) - 1
                sign = signatures(values, at)
                digest = [hashlib.md5(values[at[r] : at[r + 1]]).digest() for r in range(rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array(np.diff(at)), pa.array(digest, type=pa.binary()), pa.array([s.tobytes() for s in sign], type=pa.binary())], names=["doc_id", "n", "digest", "sign"])

    return run


# --- chosen paths ---------------------------------------------------------------------------------------------------


def missed(threshold: float, depth: int, trees: int) -> float:
    """Chance that a pair at ``threshold`` shares no node at ``depth``.

    All trees use one signature, so it is a mean over the number of coordinates on which the pair agrees.
    """
    out = 0.0
    for agree in range(COORDINATES + 1):
        lost = 0.0
        for _ in range(depth):
            one = 1 - agree / COORDINATES * (1 - lost)
            lost = (1 - BRANCH_TWO) * one + BRANCH_TWO * one * one
        out += math.comb(COORDINATES, agree) * threshold**agree * (1 - threshold) ** (COORDINATES - agree) * lost**trees
    return out


def trees_for(threshold: float, depth: int, miss: float = MISS) -> int:
    """Trees so that a pair at ``threshold`` shares no node with ``miss`` at most, also where large nodes branch again."""
    trees = 1
    while missed(threshold, depth + LEVELS_MORE, trees) > miss and trees < 1000:
        trees += 1
    return trees


def branch(path: np.ndarray, row: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes for the documents in them: (path, row)."""
    choice = tv.mix(path ^ _U(0x5851F42D4C957F2D))
    one = (choice % _U(COORDINATES)).astype(np.int64)
    two = (one + 1 + (choice >> _U(20)).astype(np.int64) % (COORDINATES - 1)) % COORDINATES
    twice = (choice >> _U(48)).astype(np.float64) / 65536.0 < BRANCH_TWO
    row2, c = np.concatenate([row, row[twice]]), np.concatenate([one, two[twice]])
    parent = np.concatenate([path, path[twice]])
    return tv.mix(parent * _U(0xD6E8FEB86659FD93) + (c.astype(np.uint64) << _U(32)) + sign[row2, c]), row2


def _paths(trees: int, depth: int):
    """v, n, sign -> node memberships at ``depth`` (path, v, n, two halves of the sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 2048):
                b = batch.slice(part, 2048)
                sign = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype="<u4").reshape(-1, COORDINATES)
                row = np.tile(np.arange(len(sign)), trees)
                path = np.repeat(tv.mix(np.arange(1, trees + 1, dtype=np.uint64)), len(sign))
                for _ in range(depth):
                    path, row = branch(path, row, sign)
                yield _members(path, row, b, sketches(sign))

    return run


def _members(path: np.ndarray, row: np.ndarray, b: pa.RecordBatch, half: np.ndarray) -> pa.RecordBatch:
    take = pa.array(row)
    return pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), b.column(0).take(take), b.column(1).take(take), pa.array(half[row, 0].view(np.int64)), pa.array(half[row, 1].view(np.int64))], names=["path", "v", "n", "s0", "s1"])


def _deeper():
    """path, v, n, sign -> the children of these memberships."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 8192):
                b = batch.slice(part, 8192)
                sign = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype="<u4").reshape(-1, COORDINATES)
                path, row = branch(b.column(0).to_numpy().view(np.uint64), np.arange(len(sign)), sign)
                yield _members(path, row, b.select([1, 2, 3]), sketches(sign))

    return run


def _compare(percent: int, last: bool):
    """Memberships sorted by path -> (a, b, path): candidate pairs (path null), or memberships of large nodes (b null).

    At the last level the members of a large node become pairs with its first member.  Only rows of nodes that may
    still be small are held, LEAF at most of an open node.
    """
    agree = COORDINATES * (0.5 + 0.5 * (percent / 100)) - 5.5 * math.sqrt(COORDINATES * 0.25 * (1 - (percent / 100) ** 2))

    def pairs(path: np.ndarray, v: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        for d in range(1, LEAF):
            i = np.flatnonzero(path[d:] == path[:-d])
            if not len(i):
                break
            j = i + d
            small, great = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            same = COORDINATES - np.bitwise_count((s[i] ^ s[j]).view(np.uint64)).sum(axis=1)
            ok = (100 * small >= percent * great) & (same >= agree) & (v[i] != v[j])
            left.append(np.minimum(v[i[ok]], v[j[ok]]))
            right.append(np.maximum(v[i[ok]], v[j[ok]]))
        if not left:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
        return both[:, 0], both[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "path"]

        def of_pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=names)

        def of_large(v: np.ndarray, path: np.ndarray, anchor: np.ndarray) -> pa.RecordBatch:
            if last:
                return of_pairs(np.minimum(v, anchor), np.maximum(v, anchor)).filter(pa.array(v != anchor))
            return pa.RecordBatch.from_arrays([pa.array(v), pa.nulls(len(v), pa.int64()), pa.array(path)], names=names)

        held = None  # rows of the node at the end of the last batch, while it may be small
        large = None  # (path, first member) of a node at the end of the last batch that is large
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(5)]
            if large is not None:
                cut = int(np.searchsorted(now[0], large[0], side="right"))
                if cut:
                    yield of_large(now[1][:cut], now[0][:cut], np.full(cut, large[1]))
                    now = [x[cut:] for x in now]
                if not len(now[0]):
                    continue
                large = None
            if held is not None:
                now = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
                held = None
            path = now[0]
            if not len(path):
                continue
            heads = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
            size = np.diff(np.append(heads, len(path)))
            big = np.repeat(size > LEAF, size)
            tail = len(path) - size[-1]
            if size[-1] > LEAF:
                large = (path[-1], now[1][tail])
            else:
                held = [x[tail:] for x in now]
                big[tail:] = True  # not yet
            small = ~big
            if small.any():
                a, b = pairs(path[small], now[1][small], now[2][small], np.stack([now[3][small], now[4][small]], axis=1))
                if len(a):
                    yield of_pairs(a, b)
            if held is not None:
                big[tail:] = False
            if big.any():
                anchor = np.repeat(now[1][heads], size)
                yield of_large(now[1][big], path[big], anchor[big])
        if held is not None:
            a, b = pairs(held[0], held[1], held[2], np.stack([held[3], held[4]], axis=1))
            if len(a):
                yield of_pairs(a, b)

    return run


def candidates(reps: DataFrame, scratch: Scratch, percent: int, count: int) -> DataFrame:
    """Candidate pairs (a, b) of representatives reps(v, n, sign).

    The depth is that at which a node holds LEAF strangers, if one in STRANGERS shares a minwise token.
    """
    depth = min(8, max(2, round(math.log(max(count, 2) / LEAF) / math.log(STRANGERS))))
    trees = trees_for(percent / 100, depth)
    members = reps.select("v", "n", "sign").mapInArrow(_paths(trees, depth), "path long, v long, n long, s0 long, s1 long")
    found = None
    for level in range(LEVELS_MORE + 1):
        last = level == LEVELS_MORE
        dealt = members.repartition("path").sortWithinPartitions("path")
        seen = scratch.keep(dealt.mapInArrow(_compare(percent, last), "a long, b long, path long"), f"level{level}")
        pairs = seen.where("b is not null").select("a", "b")
        found = pairs if found is None else found.union(pairs)
        large = seen.where("b is null").select("path", F.col("a").alias("v"))
        if last or large.isEmpty():
            break
        members = large.join(reps.select("v", "n", "sign"), "v").select("path", "v", "n", "sign").mapInArrow(_deeper(), "path long, v long, n long, s0 long, s1 long")
    return found


# --- exact classes of clusters --------------------------------------------------------------------------------------


def exact_classes(values: np.ndarray, at: np.ndarray, percent: int, known: np.ndarray | None = None, rows: np.ndarray | None = None, top: int | None = None) -> np.ndarray:
    """A class number for each set: linked sets (intersection * 100 >= percent * union) are in one class.

    ``known`` gives classes that are already found.  Sets outside the largest class are compared with all, one after
    the other, by counting the postings of their shingles.  With ``rows`` only those sets are, whatever the size of
    their class, as the others do not ask here; but for those that have joined the class of set ``top``, to which
    every set of another class comes with its own question.
    """
    m = len(at) - 1
    n = np.diff(at)
    label = np.arange(m) if known is None else np.unique(known, return_inverse=True)[1]
    if m < 2:
        return label
    _, token = np.unique(values, return_inverse=True)
    owner = np.repeat(np.arange(m), n)
    order = np.argsort(token, kind="stable")
    posting = owner[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(token))])
    parent, size = list(range(m)), np.bincount(label, minlength=m).tolist()  # of class numbers
    name = label.tolist()

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    largest = int(np.argmax(size))
    todo = list(range(m)) if rows is None else rows.tolist()
    while todo:
        left = []
        for i in todo:
            mine = root(name[i])
            if rows is None:
                settled = size[largest] > 1 and mine == largest
            else:
                settled = top is not None and mine == root(name[top])
            if settled:
                left.append(i)  # asks after all if another class becomes the largest
                continue
            if not n[i] or size[largest] == m:
                continue
            own = token[at[i] : at[i + 1]]
            hit = posting[tv.gather(start[own], start[own + 1] - start[own])]
            if len(hit) < m // 8:  # as much work as there are sets that share a shingle
                there, inter = np.unique(hit, return_counts=True)
            else:
                inter = np.bincount(hit, minlength=m)
                there = np.flatnonzero(inter)
                inter = inter[there]
            for j in there[100 * inter >= percent * (n[i] + n[there] - inter)].tolist():
                mine, other = root(name[i]), root(name[j])
                if mine != other:
                    parent[other] = mine
                    size[mine] += size[other]
                    if size[mine] > size[largest] or other == largest:
                        largest = mine
        if len(left) == len(todo) or size[largest] == m:
            break
        todo = left if rows is None else []
    return np.unique([root(c) for c in name], return_inverse=True)[1]


def _blocks(percent: int):
    """Rows (g, v, label, row, top, values) sorted by g -> links (a, b) that join the classes of each group g."""

    def classes(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows)
        held: dict[tuple[int, bytes], int] = {}  # a document with several texts has several sets
        for i, (x, raw) in enumerate(zip(t.column("v").to_pylist(), (c for chunk in t.column("values").chunks for c in chunk), strict=True)):
            held.setdefault((x, hashlib.md5(raw.as_buffer()).digest()), i)
        if len(held) < 2:
            return None
        t = t.take(pa.array(list(held.values())))
        v, raw = t.column("v").to_numpy(), t.column("values").combine_chunks()
        if isinstance(raw, pa.ChunkedArray):
            raw = pa.concat_arrays(raw.chunks)
        data, offs = tv.buffers(raw)
        values = np.frombuffer(data.tobytes(), dtype="<u8")
        row = np.flatnonzero(t.column("row").to_numpy(zero_copy_only=False))
        top = np.flatnonzero(t.column("top").to_numpy(zero_copy_only=False))
        label = exact_classes(values, offs // 8, percent, t.column("label").to_numpy(), None if len(row) == len(v) else row, int(top[0]) if len(top) else None)
        first = np.full(label.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, label, v)
        link = first[label] != v
        if not link.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(first[label][link]), pa.array(v[link])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            g = batch.column(0).to_numpy()
            if not len(g):
                continue
            heads = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(g)], strict=True):
                if g[a] != now and held:
                    out = classes(held)
                    if out is not None:
                        yield out
                    held = []
                now = g[a]
                held.append(batch.slice(a, b - a))
        if held:
            out = classes(held)
            if out is not None:
                yield out

    return run


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int, few: bool) -> DataFrame:
    """v, values (sorted 64-bit shingles) for the representatives in ``wanted``; a task gives a set of a v but once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, bytes]] = set()
        for batch in batches:
            for first, values, at in sets(batch.column(1), k):
                v, held = batch.column(0).slice(first, len(at) - 1).to_pylist(), []
                for r, x in enumerate(v):
                    own = values[at[r] : at[r + 1]].tobytes()
                    name = (x, hashlib.md5(own).digest())
                    if name not in given:
                        given.add(name)
                        held.append((x, own))
                if len(given) > GIVEN:
                    given.clear()
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], type=pa.int64()), pa.array([own for _, own in held], type=pa.binary())], names=["v", "values"])

    ids = wanted.select(F.col("v").alias("doc_id"))
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "v long, values binary")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``; links are percent / 100 Jaccard or more."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "neardup")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    described = scratch.keep(source.mapInArrow(_describe(words), "doc_id long, n long, digest binary, sign binary"), "described")
    filled = described.where("n > 0 and doc_id is not null")
    # one row of each group of equal sets, combined map-side: a hot group sends one row a task
    groups = scratch.keep(filled.groupBy("digest").agg(F.min_by(F.struct(F.col("doc_id").alias("v"), "n", "sign"), "doc_id").alias("x")).select("digest", "x.*"), "groups")
    reps = groups.select("v", "n", "sign")

    pairs = candidates(reps, scratch, percent, reps.count())
    cluster = scratch.keep(components(pairs, scratch, "cluster"), "clusters")
    sized = cluster.join(reps.groupBy("v").agg(F.sum("n").alias("n")), "v")
    weight = sized.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(block_shingles)).cast("int").alias("blocks"))
    member = scratch.keep(sized.join(weight, "root"), "member")
    few = member.count() <= BROADCAST_IDS
    full = _full_sets(source, member, words, few)

    def meet(rows: DataFrame) -> DataFrame:
        return rows.select("g", "v", "label", "row", "top", "values").repartition("g").sortWithinPartitions("g", "v").mapInArrow(_blocks(percent), "a long, b long")

    single = member.where("blocks <= 1").select("v", F.col("root").alias("g"), F.col("v").alias("label"), F.lit(True).alias("row"), F.lit(False).alias("top"))
    links = meet(single.join(full, "v"))
    large = member.where("blocks > 1")
    if not large.isEmpty():
        links = links.union(_large_clusters(large, full, scratch, meet, block_shingles))
    found = components(scratch.keep(links, "links"), scratch, "class").where("v <> root")
    scratch.drop("level*", "cluster*", "member", "large*", "links")
    ids = groups.select("v", "digest").join(found, "v", "left").select("digest", F.coalesce("root", "v").alias("component_id"))
    out = described.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.expr("n > 0 and doc_id is not null"), F.col("digest")).alias("digest")).join(ids, "digest", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def _large_clusters(large: DataFrame, full: DataFrame, scratch: Scratch, meet, block_shingles: int) -> DataFrame:
    """Links of clusters whose sets do not fit one task.  Two rounds over blocks of bounded size."""
    base = large.withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    pivots = large.groupBy("root", "blocks").agg(F.array_distinct(F.array(*[F.min_by("v", F.xxhash64("v", F.lit(i))) for i in range(PIVOTS)])).alias("p"))
    pivot = pivots.select("root", "blocks", F.explode("p").alias("v")).select("root", "v", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    both = base.select("root", "v", "block").union(pivot).distinct()
    key = F.xxhash64("root", "block")
    one = scratch.keep(meet(both.select("v", key.alias("g"), F.col("v").alias("label"), F.lit(True).alias("row"), F.lit(False).alias("top")).join(full, "v")), "large1")
    class_ = components(one, scratch, "largec")
    now = base.join(class_.withColumnRenamed("root", "label"), "v", "left").withColumn("label", F.coalesce("label", "v"))
    now = scratch.keep(now, "large2")
    size = now.groupBy("root", "label").agg(F.count(F.lit(1)).alias("c"))
    top = size.groupBy("root").agg(F.max_by("label", F.struct("c", "label")).alias("top"))
    rest = now.join(top, "root").where("label <> top")
    lots = rest.groupBy("root").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / F.lit(block_shingles))).cast("int").alias("lots"))
    lot = rest.join(lots, "root").withColumn("lot", F.pmod(F.xxhash64("v", F.lit(7)), F.col("lots")).cast("int"))
    asking = lot.select("root", "v", "label", "lot", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(True).alias("row"), F.lit(False).alias("top"))
    asked = now.join(lots, "root").join(top, "root").select("root", "v", "label", F.explode(F.expr("sequence(0, lots - 1)")).alias("lot"), "block", F.lit(False).alias("row"), (F.col("label") == F.col("top")).alias("top"))
    both = asking.unionByName(asked).groupBy("root", "lot", "block", "v", "label").agg(F.max("row").alias("row"), F.max("top").alias("top"))
    two = meet(both.select("v", F.xxhash64("root", "lot", "block").alias("g"), "label", "row", "top").join(full, "v"))
    return one.union(two)
