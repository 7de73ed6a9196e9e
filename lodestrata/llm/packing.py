"""Sum-of-squares packing of token pieces into sequences of a fixed length.

Documents become ids plus an end id; longer ones are cut so that every piece but the first is full.  A full piece is
a sequence by itself.  The others are packed by the sum-of-squares rule: a piece goes where the sum, over residual
gaps, of the squared number of open sequences with that gap becomes smallest.  Gaps are counted one by one and in
classes of several widths, and the packing with fewest sequences is taken.  Lengths alone decide, so only small
rows are dealt out, by their place and not by what they hold, so that repeated rows do not meet: groups of a
documented size are packed independently, each in one bounded task; what lies in
sequences that are not full is packed again, first within the group, then once together with all other groups'.

Defined cases: a null text is empty (its only piece holds the end id); a null doc_id is kept as null; repeated rows
are packed once for every row; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import subwords as sw
from lodestrata.llm.runtime import Scratch, ship

#: Pieces that one task packs: more leave fewer part-filled sequences, fewer make smaller tasks.
GROUP_PIECES = 8192
#: Widths of gap classes that are tried on all pieces of a group, and on those of part-filled sequences.
FIRST_WIDTHS, WIDTHS = (1, 16, 256), (1, 4, 16, 64, 256)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long"


def place(lengths: np.ndarray, size: int, width: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum-of-squares placement, longest first: (sequence, offset) of each piece, and the fill of each sequence.

    Residual gaps are counted in classes ``width`` tokens wide (1: each gap by itself); those of less than ``width``
    count as closed.  With N(a) open sequences in class a, moving one from a to b changes the sum of squares by
    2 (N(b) - N(a)) + 2, by 0 if a = b, by 1 - 2 N(a) where it becomes closed; a new sequence adds 2 N(b) + 1.  Ties go
    to the fullest sequence.
    """
    order = np.argsort(-lengths, kind="stable")
    class_of = (size - np.arange(size + 1)) // width  # of a sequence filled so far
    inside = np.zeros(int(class_of.max()) + 1, dtype=np.int64)
    count = np.zeros(size + 1, dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(size + 1)]
    fill: list[int] = []
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    far = np.int64(1) << 40
    for i, s in zip(order.tolist(), lengths[order].tolist(), strict=True):
        top = size - s  # fills up to this have room
        h = 0
        if top > 0:
            a, b = class_of[1 : top + 1], class_of[1 + s : size + 1]
            left = inside[a]
            change = np.where(b == 0, 1 - 2 * left, 2 * (inside[b] - left) + 2)
            change[a == b] = 0
            change[count[1 : top + 1] == 0] = far
            best = top - 1 - int(change[::-1].argmin())
            fresh = 2 * inside[class_of[s]] + 1 if class_of[s] else 0
            if change[best] < min(fresh, far):
                h = best + 1
        if h:
            k = open_at[h].pop()
            count[h] -= 1
            inside[class_of[h]] -= class_of[h] > 0
        else:
            k = len(fill)
            fill.append(0)
        sequence[i], offset[i] = k, h
        fill[k] = h + s
        if h + s < size:
            open_at[h + s].append(k)
            count[h + s] += 1
            inside[class_of[h + s]] += class_of[h + s] > 0
    return sequence, offset, np.array(fill, dtype=np.int64)


def place_best(lengths: np.ndarray, size: int, widths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`place` with each width of gap classes; the one with fewest sequences (the first of equals)."""
    least, best = -(-int(lengths.sum()) // size), None
    for width in widths:
        now = place(lengths, size, min(width, size))
        if best is None or len(now[2]) < len(best[2]):
            best = now
        if len(best[2]) <= least:
            break
    return best


def place_repeatedly(lengths: np.ndarray, size: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`place_best`, then the pieces of sequences that are not full are taken out and placed again by the same
    rule, as long as that saves sequences."""
    sequence, offset, fill = place_best(lengths, size, FIRST_WIDTHS)
    loose = np.arange(len(lengths))
    for _ in range(rounds):
        loose = loose[fill[sequence[loose]] < size]
        if not len(loose):
            break
        inner, shift, fresh = place_best(lengths[loose], size, WIDTHS)
        before = len(np.unique(sequence[loose]))
        if len(fresh) >= before:
            break
        sequence[loose], offset[loose] = inner + len(fill), shift
        fill = np.concatenate([fill, fresh])
    return sequence, offset, fill


def pieces(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece of every document; full pieces have their sequence already.  ``with_ids`` adds the ids (binary)."""
    spark = docs.sparkSession
    ship(spark)
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = -1 - (TaskContext.get().partitionId() << 40)  # sequences of full pieces: negative numbers
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            names = batch.column(0)
            for first, ids, at in sw.byte_level_ids(batch.column(1), tokenizer, run_id):
                n = np.diff(at) + 1
                count = (n + size - 1) // size
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                head = n - (count - 1) * size
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * size)
                length = np.where(piece == 0, head[row], size)
                crc, held = np.zeros(len(row), dtype=np.int64), []
                ids = ids.astype("<u4")
                for k, (r, a, m) in enumerate(zip(row.tolist(), start.tolist(), length.tolist(), strict=True)):
                    own = ids[at[r] + a : at[r] + a + m] if a + m < n[r] else np.concatenate([ids[at[r] + a : at[r + 1]], end])
                    crc[k] = zlib.crc32(own.view(np.uint8))
                    if with_ids:
                        held.append(own.tobytes())
                full = length == size
                seq = number - np.cumsum(full) + 1
                number -= int(full.sum())
                columns = [names.take(pa.array(row + first)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(seq, mask=~full)]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(held, type=pa.binary())] if with_ids else []), names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id"] + ["ids"] * with_ids)

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, group_pieces: int = GROUP_PIECES, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and its offset there (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    ``with_ids`` keeps the ids beside each piece, for :func:`sequences`.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = pieces(docs, tokenizer, size, end_id, id_col, text_col, with_ids)
    cut = scratch.keep(cut.withColumn("lot", F.monotonically_increasing_id()), "pieces")  # written: a piece keeps its lot
    whole = cut.where("sequence_id is not null").withColumn("offset", F.lit(0).cast("long"))
    part = cut.where("sequence_id is null").drop("sequence_id")
    groups = max(1, -(-part.count() // group_pieces))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sequence, offset, fill = place_repeatedly(table.column("length").to_numpy(), size)
        number = sequence + (key[0].as_py() << 32)
        return table.select(names).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset)).append_column("full", pa.array(fill[sequence] == size))

    names = list(part.columns)
    schema = ", ".join(f"{n} {t}" for n, t in part.dtypes) + ", sequence_id long, offset long, full boolean"

    def deal(rows: DataFrame, count: int, base: int) -> DataFrame:
        key = F.pmod(F.xxhash64("lot"), F.lit(count)).cast("long") + F.lit(base)
        return rows.withColumn("g", key).groupBy("g").applyInArrow(run, schema)

    packed = scratch.keep(deal(part, groups, 0), "packed")
    if groups > 1:  # the pieces of all groups' sequences that are not full, once more together
        loose = packed.where("not full").select(*names)
        again = max(1, -(-loose.count() // group_pieces))
        placed = packed.where("full").unionByName(scratch.keep(deal(loose, again, groups), "again"))
    else:
        placed = packed
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return whole.select(columns).unionByName(placed.select(columns))


def sequences(packed: DataFrame) -> DataFrame:
    """Packed rows with ids as whole sequences: sequence_id, length, ids (binary, unsigned 32-bit), doc_ids, offsets.

    A sequence holds at most as many pieces as it has tokens, so each group is bounded.
    """
    rows = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), rows.alias("r")).select("sequence_id", "length", F.expr("aggregate(r, binary(''), (a, x) -> concat(a, x.ids))").alias("ids"), F.expr("r.doc_id").alias("doc_ids"), F.expr("r.offset").alias("offsets"))
