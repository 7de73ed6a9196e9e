"""Nearest neighbours by multi-index hashing over learned binary codes.

Fit (on a bounded sample): vectors are scaled to length one, centred, turned by principal components and by a rotation
that is learned so that signs lose little (iterative quantisation); the signs are the code.  Two things are learned
about distances of codes: the radius within which the sample's true neighbours lie with probability ``REACH``, and the
distance that pairs of a given cosine keep to with the same probability.  Index: a code is cut into substrings, and in
each block of rows every substring has its own table (rows sorted by its value); blocks are written once.

Search, with growing radii: if two codes differ in r bits at most, some substring differs in floor(r / substrings) at
most, so probing all values that near in every table retrieves every code within the radius; those are compared as
whole codes, and what is within the radius is ranked by the cosine of the original vectors in double precision.  The
first round probes equal substrings only.  A query whose k-th cosine so far is so large that rows as near keep to that
radius is done; the others go on with the radius that their k-th cosine asks for, the learned one at most; a query that
still has fewer than k is given the whole code, so that k are found whenever there are as many candidates.

Every row is indexed, every query sees every block; queries go to the blocks in broadcast parts of at most
``QUERY_BYTES``, part after part, so nothing that grows with the data is broadcast at once.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite numbers take no
part, and rows without id neither; finite vectors of any magnitude do (they are scaled by a power of two first); a
query has fewer results only if there are fewer candidates; candidates of equal cosine are ranked by id; repeated ids
are separate candidates; all rows with the query's own id are left out; if a query's id occurs in several rows, each
of these rows is a query with results of its own; other columns are ignored; no rows, no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm import textvec as tv
from lodestrata.llm.runtime import Scratch, ship

SAMPLE, BLOCK_ROWS, BLOCK_BYTES, QUERY_BYTES = 4000, 16_384, 16 << 20, 16 << 20
SUBSTRING_BITS, REACH = 8, 0.985
#: Bins of cosines from -1 to 1 for which distances are learned, and the pairs that a bin needs.
BINS, LEAST_PAIRS = 40, 50


@dataclass
class Index:
    """What fitting learns: centre, projection (dimension x bits), radius, and a distance for each bin of cosines."""

    centre: np.ndarray
    turn: np.ndarray
    radius: int
    keeps: np.ndarray

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Bytes (= substrings) of the codes of unit vectors."""
        return np.packbits((unit - self.centre) @ self.turn > 0, axis=1)

    def needed(self, cosine: np.ndarray) -> np.ndarray:
        """The radius that rows at least as near as ``cosine`` keep to; the learned radius at most."""
        return np.minimum(self.keeps[_bin(cosine)], self.radius)


def _bin(cosine: np.ndarray) -> np.ndarray:
    return np.clip(((cosine + 1) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors (rows) times a power of two each, so that the largest component is between 1/2 and 1: exact."""
    vectors = vectors.astype(np.float64)
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0.0))
    half = exponent // 2  # in two steps: one factor alone may not be a finite number
    return np.ldexp(np.ldexp(vectors, -half[:, None]), -(exponent - half)[:, None])


def unit(vectors: np.ndarray) -> np.ndarray:
    """``vectors`` (already scaled) at length one."""
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def fit(sample: np.ndarray, k: int, rounds: int = 25, seed: int = 7) -> Index:
    """Learns rotation, radius and distances from sample vectors (rows)."""
    x = unit(scaled(sample))
    d = x.shape[1]
    centre = x.mean(axis=0)
    y = x - centre
    _, axes = np.linalg.eigh(y.T @ y)
    bits = -(-d // SUBSTRING_BITS) * SUBSTRING_BITS
    rng = np.random.default_rng(seed)
    axes = axes[:, ::-1]
    if bits > d:
        axes = np.concatenate([axes, axes[:, : bits - d]], axis=1) if bits - d <= d else axes[:, np.arange(bits) % d]
    v = y @ axes
    r = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        b = np.where(v @ r > 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(b.T @ v)
        r = (u @ w).T
    turn = axes @ r
    codes = np.packbits(y @ turn > 0, axis=1)
    asked = np.arange(0, len(x), max(1, len(x) // 400))
    far, seen = [], np.zeros((BINS, bits + 1), dtype=np.int64)
    for a in asked:
        cosine = x @ x[a]
        apart = np.bitwise_count(codes ^ codes[a]).sum(axis=1, dtype=np.int64)
        others = np.arange(len(x)) != a
        np.add.at(seen, (_bin(cosine[others]), apart[others]), 1)
        cosine[a] = -np.inf
        far.append(apart[np.argsort(-cosine, kind="stable")[: min(k, len(x) - 1)]])
    far = np.concatenate(far) if far else np.zeros(0, dtype=np.int64)
    radius = int(np.quantile(far, REACH, method="higher")) if len(far) else bits
    keeps, last = np.full(BINS, bits), bits
    for i in range(BINS):  # nearer pairs keep to no larger distance; bins with few pairs take the one before
        n = seen[i].sum()
        if n >= LEAST_PAIRS:
            last = min(last, int(np.searchsorted(np.cumsum(seen[i]), REACH * n)))
        keeps[i] = last
    return Index(centre, turn, radius, keeps)


class Tables:
    """One block of the index: a sorted table for each substring (``order``: rows by value, one row a substring)."""

    def __init__(self, codes: np.ndarray, order: np.ndarray | None = None) -> None:
        self.codes = codes
        self.order = np.stack([np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]).astype(np.int32) if order is None else order
        self.start = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes differ from ``code`` in at most ``radius`` bits."""
        each = radius // len(code)
        if each >= SUBSTRING_BITS:
            rows = np.arange(len(self.codes))
        else:
            hit = np.zeros(len(self.codes), dtype=bool)
            values = _values(each)[code]
            for order, start, v in zip(self.order, self.start, values, strict=True):
                hit[order[tv.gather(start[v], start[v + 1] - start[v])]] = True
            rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1, dtype=np.int64) <= radius]


_probes: dict[int, np.ndarray] = {}


def _values(each: int) -> np.ndarray:
    """Of each value of a substring the values that differ in ``each`` bits at most (a row a value)."""
    if each not in _probes:
        byte = np.arange(256, dtype=np.uint8)
        near = np.bitwise_count(byte[:, None] ^ byte[None, :]) <= each
        _probes[each] = np.nonzero(near)[1].reshape(256, -1)
    return _probes[each]


def _dense(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def _build(index: Index, size: int, kind: str):
    """vec_id, x, asked -> one row a block: ids, vectors, which are queries, codes, tables."""
    limit = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * size)))
    names = ["n", "ids", "x", "asked", "codes", "tables"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x = _dense(t.column(1).chunk(0)).astype(kind)
            tables = Tables(index.codes(unit(scaled(x))))
            raw = [t.column(0).to_numpy().astype("<i8"), x, t.column(2).to_numpy(zero_copy_only=False).astype(np.uint8), tables.codes, tables.order]
            return pa.RecordBatch.from_arrays([pa.array([len(x)]), *(pa.array([a.tobytes()], type=pa.binary()) for a in raw)], names=names)

        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, limit - n)
                held.append(part)
                n, at = n + part.num_rows, at + part.num_rows
                if n == limit:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return run


def _queries(size: int, kind: str):
    """Blocks -> the rows that are queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, asked in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                some = np.flatnonzero(np.frombuffer(asked, dtype=np.uint8))
                if len(some):
                    x = np.frombuffer(x, dtype=kind).reshape(-1, size)[some].astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, dtype="<i8")[some]), pa.array(list(x), type=pa.list_(pa.float64()))], names=["query_id", "x"])

    return run


def search(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row for which ``queries`` holds."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "neighbours")
    kind = "<f4" if dict(vectors.dtypes).get(vector_col) == "array<float>" else "<f8"
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"), F.coalesce(queries, F.lit(False)).alias("asked"))
    rows = rows.where("vec_id is not null and x is not null and size(x) > 0").where("forall(x, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(x, v -> v <> 0)")
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = size["d"]
    rows = rows.where(F.size("x") == size)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(SAMPLE).select("x").toArrow()
    index = fit(_dense(sample.column("x").combine_chunks()), k)
    bits = index.turn.shape[1]
    blocks = scratch.keep(rows.mapInArrow(_build(index, size, kind), "n long, ids binary, x binary, asked binary, codes binary, tables binary"), "blocks")
    asked = blocks.select("ids", "x", "asked").mapInArrow(_queries(size, kind), "query_id long, x array<double>")
    asked = scratch.keep(asked.withColumn("q", F.monotonically_increasing_id()), "asked")  # written: a query keeps its number
    parts = max(1, -(-asked.count() * 8 * size // QUERY_BYTES))
    found = None
    for part in range(parts):
        got = asked.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part).toArrow().sort_by("q")  # QUERY_BYTES or so
        q, ids = got.column("q").to_numpy(), got.column("query_id").to_numpy()
        x = scaled(_dense(got.column("x").combine_chunks())) if len(q) else None
        radius, todo = np.full(len(q), bits // SUBSTRING_BITS - 1), np.arange(len(q))  # first: equal substrings
        while len(todo):
            held = spark.sparkContext.broadcast((index, size, kind, q[todo], ids[todo], x[todo], radius[todo]))
            seen = blocks.select("ids", "x", "codes", "tables").mapInArrow(_probe(held, k), "q long, query_id long, vec_id long, score double")
            one = scratch.keep(_top(seen, k), f"part{part}-{len(found or [])}")
            last = one.where(F.col("rank") == k).select("q", "score").toArrow()  # a row a query of this part
            kth = np.full(len(q), np.nan)
            kth[np.searchsorted(q, last.column("q").to_numpy())] = last.column("score").to_numpy()
            wider = np.where(radius < index.radius, index.radius, bits)
            need = np.where(np.isnan(kth), wider, index.needed(np.nan_to_num(kth)))
            again = need[todo] > radius[todo]
            if again.any():
                one = one.join(F.broadcast(spark.createDataFrame(pa.table({"q": q[todo[again]]}))), "q", "left_anti")
            found = [*(found or []), one]
            radius = np.maximum(radius, need)
            todo = todo[again]
    scratch.drop("blocks", "asked")
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found).select("query_id", "rank", "vec_id", "score")


def _top(df: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _probe(held, k: int):
    """Each block's k nearest of each query, within the query's radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, size, kind, number, query_ids, query_x, radius = held.value
        query_code = index.codes(unit(query_x))
        norm = np.sqrt(np.einsum("ij,ij->i", query_x, query_x))
        substrings = query_code.shape[1]
        for batch in batches:
            for raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids, x = np.frombuffer(raw[0], dtype="<i8"), scaled(np.frombuffer(raw[1], dtype=kind).reshape(-1, size))
                tables = Tables(np.frombuffer(raw[2], dtype=np.uint8).reshape(-1, substrings), np.frombuffer(raw[3], dtype=np.int32).reshape(substrings, -1))
                length = np.sqrt(np.einsum("ij,ij->i", x, x))
                out = []
                for i in range(len(number)):
                    near = tables.within(query_code[i], int(radius[i]))
                    near = near[ids[near] != query_ids[i]]
                    if not len(near):
                        continue
                    if len(near) > k:  # first by a product whose last digits depend on a row's place, with room for them
                        rough = ((x @ query_x[i])[near] if 8 * len(near) > len(x) else x[near] @ query_x[i]) / length[near]
                        least = np.partition(rough, len(rough) - k)[len(rough) - k]
                        near = near[rough >= least - 1e-12 * norm[i]]
                    score = (x[near] * query_x[i]).sum(axis=1) / (length[near] * norm[i])
                    order = np.lexsort((ids[near], -score))[:k]
                    out.append((np.full(len(order), number[i]), np.full(len(order), query_ids[i]), ids[near[order]], score[order]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["q", "query_id", "vec_id", "score"])

    return run
