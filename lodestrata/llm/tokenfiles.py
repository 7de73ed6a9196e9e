"""Token files: frequency-ranked ids, byte-aligned variable-length code, control bytes apart from data bytes.

Pass 1 encodes every text once and writes its ids to a shared table; ids are counted there (each task sends at most one
row an id) and ranked: the most frequent id gets rank 0.  Pass 2 codes each document by ranks, deals documents to shards
of about equal bytes, by ranges of (doc_id, checksum, row), so that neither long documents nor a doc_id of many rows
fill one shard, and each shard's task streams them, in order, into one file.  A rank takes 1 to 4 bytes; 2 bits a rank in the control bytes say how many.  Reading looks the
lengths of four ranks up by control byte and gathers the data with numpy.

File (little endian): ``LSVB0001``, then for each document its control bytes and its data bytes, then arrays of
doc_id (int64), null flag (uint8), number of ids (int64) and place (int64, one more than documents), then the number
of documents and the place of the arrays (int64 each).  ``ranks.u32`` beside the shards lists the ids by rank.

A task writes a file under a name of its own and reports it in the manifest; only files in the manifest are read, so
repeated or lost tasks do no harm.  The folder must be one that pyarrow's file systems open on all machines.

Defined cases: a null text is empty (one id: the end id); a null doc_id comes before all others; rows that share a
doc_id stay, in the order of their checksums; long texts and repeated ids are dealt like others; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import bisect
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm import subwords as sw
from lodestrata.llm.runtime import Scratch, ship

MAGIC = b"LSVB0001"
#: Stands for a null doc_id in the order of rows.
NULL_ID = -(1 << 63)
SHARD_BYTES = 16 << 20
#: Shards at most (they become larger instead), and rows sampled a shard to find their bounds: the driver holds those.
MOST_SHARDS, SAMPLE_ROWS = 50_000, 20
#: Lengths of the four ranks of each control byte, and the mask of each length.
LENGTHS = np.array([[(c >> (2 * j) & 3) + 1 for j in range(4)] for c in range(256)], dtype=np.int64)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    n = len(ranks)
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-n // 4) * 4, dtype=np.uint8)
    codes[:n] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    keep = np.arange(4, dtype=np.uint8)[None, :] < size[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def decode(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ranks again, by table lookup."""
    size = LENGTHS[control].ravel()[:n]
    at = np.cumsum(size) - size
    padded = np.zeros(len(data) + 4, dtype=np.uint8)
    padded[: len(data)] = data
    four = np.ndarray(shape=(len(data) + 1,), dtype="<u4", buffer=padded, strides=(1,))
    return four[at] & MASKS[size]


def data_size(control: np.ndarray, n: int) -> int:
    return int(LENGTHS[control].ravel()[:n].sum())


def open_folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1))


def encode_texts(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n, crc, ids (binary, 16 bits an id if all ids of the vocabulary fit, else 32; the end id included)."""
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = sw.largest_id(tokenizer, end_id) > 0xFFFF
        for batch in batches:
            for first, ids, at in sw.byte_level_ids(batch.column(1), tokenizer, run_id):
                rows = len(at) - 1
                held, crc = [], np.zeros(rows, dtype=np.int64)
                for r in range(rows):
                    own = np.append(ids[at[r] : at[r + 1]], np.uint32(end_id)).astype("<u4")
                    crc[r] = zlib.crc32(own.view(np.uint8))
                    held.append((own if wide else own.astype("<u2")).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array(np.diff(at) + 1), pa.array(crc), pa.array(held, type=pa.binary()), pa.array(np.full(rows, wide))], names=["doc_id", "n", "crc", "ids", "wide"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, crc long, ids binary, wide boolean")


def _ids(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u4" if wide else "<u2")


def count_ids(encoded: DataFrame) -> DataFrame:
    """id, n over the whole table of encoded texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for raw, wide in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.bincount(_ids(raw, wide), minlength=len(total))
                more[: len(total)] += total
                total = more
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    return encoded.select("ids", "wide").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def shard_bounds(encoded: DataFrame, shard_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First (doc_id, crc, lot) of each shard but the first, from a sample in which a row's chance grows with its bytes."""
    size = F.octet_length("ids").cast("double")
    total = encoded.agg(F.coalesce(F.sum(size), F.lit(0.0)).alias("b")).first()["b"]
    shards = min(MOST_SHARDS, max(1, math.ceil(total / shard_bytes)))
    if shards == 1:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    step = total / max(2000, SAMPLE_ROWS * shards)  # bytes that a sampled row stands for at least
    chance = F.pmod(F.xxhash64("lot"), F.lit(1 << 30)) / float(1 << 30)
    rows = encoded.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("d"), "crc", "lot", F.greatest(size, F.lit(step)).alias("w")).where(chance * step < size).toArrow()
    d, c, k, w = (rows.column(x).to_numpy() for x in ("d", "crc", "lot", "w"))
    order = np.lexsort((k, c, d))
    seen = np.cumsum(w[order])
    cut = np.unique(np.searchsorted(seen, seen[-1] * np.arange(1, shards) / shards)) if len(seen) else np.zeros(0, dtype=np.int64)
    cut = cut[cut > 0]
    return d[order][cut], c[order][cut], k[order][cut]


def shards_of(bounds: tuple[np.ndarray, np.ndarray, np.ndarray], d: np.ndarray, c: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The number of bounds that are not above each (doc_id, crc, lot)."""
    low, high = np.searchsorted(bounds[0], d, side="left"), np.searchsorted(bounds[0], d, side="right")
    inner: dict[int, list[tuple[int, int]]] = {}
    for r in np.flatnonzero(low < high).tolist():  # rows of a doc_id that bounds divide
        a, b = int(low[r]), int(high[r])
        if a not in inner:
            inner[a] = list(zip(bounds[1][a:b].tolist(), bounds[2][a:b].tolist(), strict=True))
        low[r] = a + bisect.bisect_right(inner[a], (int(c[r]), int(k[r])))
    return low


def write(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files; returns the manifest (shard, path, n_docs, n_tokens, base: ids in the shards before)."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "tokenfiles")
    folder = (folder or f"{scratch.path}/files").rstrip("/")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    encoded = scratch.keep(encode_texts(source, tokenizer, end_id).withColumn("lot", F.monotonically_increasing_id()), "encoded")
    bounds = shard_bounds(encoded, shard_bytes)
    counts = {end_id: 0} | {r["id"]: r["n"] for r in count_ids(encoded).collect()}  # as many rows as the vocabulary has ids
    by_rank = np.array(sorted(counts, key=lambda i: (-counts[i], i)), dtype="<u4")
    rank_of = np.zeros(int(by_rank.max()) + 1, dtype=np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    system, base = open_folder(folder)
    system.create_dir(base, recursive=True)
    with system.open_output_stream(f"{base}/ranks.u32") as out:
        out.write(by_rank.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            lot = batch.column(5)
            shard = shards_of(bounds, names.fill_null(NULL_ID).to_numpy(), batch.column(2).to_numpy(), lot.to_numpy())
            control, data = [], []
            for raw, wide in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                c, d = encode(rank_of[_ids(raw, wide)])
                control.append(c)
                data.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), names, batch.column(1), batch.column(2), pa.array(control, type=pa.binary()), pa.array(data, type=pa.binary()), lot], names=["shard", "doc_id", "n", "crc", "control", "data", "lot"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base, out, shard = *open_folder(folder), None, 0
        names, none, count, place = [], [], [], [len(MAGIC)]
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                shard = batch.column(0)[0].as_py()
                path = f"{base}/shard-{shard:06d}-{uuid.uuid4().hex}.lsvb"
                out = system.open_output_stream(path)
                out.write(MAGIC)
            names.append(batch.column(1).fill_null(0).to_numpy())
            none.append(batch.column(1).is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
            count.append(batch.column(2).to_numpy())
            for c, d in zip(batch.column(4), batch.column(5), strict=True):
                c, d = c.as_buffer(), d.as_buffer()
                out.write(c)
                out.write(d)
                place.append(place[-1] + c.size + d.size)
        if out is None:
            return
        count = np.concatenate(count).astype("<i8")
        for part in (np.concatenate(names).astype("<i8"), np.concatenate(none), count, np.array(place, dtype="<i8"), np.array([len(count), place[-1]], dtype="<i8")):
            out.write(part.tobytes())
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([shard], type=pa.int32()), pa.array([path]), pa.array([len(count)], type=pa.int64()), pa.array([int(count.sum())], type=pa.int64())], names=["shard", "path", "n_docs", "n_tokens"])

    coded = encoded.mapInArrow(run, "shard int, doc_id long, n long, crc long, control binary, data binary, lot long")
    dealt = coded.repartitionById(len(bounds[0]) + 1, F.col("shard")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "crc", "lot")
    manifest = scratch.keep(dealt.mapInArrow(put, "shard int, path string, n_docs long, n_tokens long"), "manifest")
    scratch.drop("encoded")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("folder", F.lit(folder))


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Reads the files of a manifest back: doc_id, start, n_tokens, ids_crc32, and with ``with_ids`` the ids (binary)."""
    ship(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                system, base = open_folder(m["folder"])
                with system.open_input_stream(f"{base}/ranks.u32") as f:
                    by_rank = np.frombuffer(f.read(), dtype="<u4")
                with system.open_input_file(m["path"]) as f:
                    end = f.size()
                    f.seek(end - 16)
                    n, at = np.frombuffer(f.read(16), dtype="<i8")
                    f.seek(int(at))
                    raw = f.read(end - 16 - int(at))
                    names, none = np.frombuffer(raw[: 8 * n], dtype="<i8"), np.frombuffer(raw[8 * n : 9 * n], dtype=np.uint8).astype(bool)
                    count, place = np.frombuffer(raw[9 * n : 17 * n], dtype="<i8"), np.frombuffer(raw[17 * n :], dtype="<i8")
                    start = m["base"] + np.cumsum(count) - count
                    first = 0
                    while first < n:  # some MB at a time
                        last = min(n, max(first + 1, int(np.searchsorted(place, place[first] + (4 << 20), side="right")) - 1))
                        f.seek(int(place[first]))
                        block = np.frombuffer(f.read(int(place[last] - place[first])), dtype=np.uint8)
                        crc, held = np.zeros(last - first, dtype=np.int64), []
                        for k in range(first, last):
                            own = block[place[k] - place[first] : place[k + 1] - place[first]]
                            c = -(-int(count[k]) // 4)
                            ids = by_rank[decode(own[:c], own[c:], int(count[k]))]
                            crc[k - first] = zlib.crc32(ids.view(np.uint8))
                            if with_ids:
                                held.append(ids.tobytes())
                        columns = [pa.array(names[first:last], mask=none[first:last]), pa.array(start[first:last]), pa.array(count[first:last]), pa.array(crc)]
                        yield pa.RecordBatch.from_arrays(columns + ([pa.array(held, type=pa.binary())] if with_ids else []), names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
                        first = last

    files = max(1, manifest.count())
    return manifest.repartition(files).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))
