"""Vectorised text work on Arrow string buffers: chunks, words, 64-bit hashes, shingles.

All functions look at whole texts.  Columns are cut into chunks of rows (never of characters), so that temporary
arrays stay small; one very long text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)

#: The white space that separates words (space and 0x09 to 0x0D).
SEPARATORS = b" \t\n\x0b\x0c\r"
_SEP = np.zeros(256, dtype=bool)
_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of up to ``limit`` bytes, one row at least."""
    data, offs = buffers(column)
    row, rows = 0, len(offs) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1)
        end = min(end, rows)
        yield row, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True within each row: starts, ends, and the index of each row's first run (rows + 1 values)."""
    n = len(inside)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(offs), dtype=np.int64)
    before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    edges = offs[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans(~_SEP[data], offs)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes a step."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    length = ends - starts
    h = mix(length.astype(np.uint64) * _GOLD + np.uint64(1))
    todo, at = np.arange(len(starts)), starts
    left = length
    while len(todo):
        part = eight[at]
        short = left < 8
        if short.any():
            keep = (np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            part = np.where(short, part & keep, part)
        h[todo] = mix((h[todo] ^ part) + _GOLD)
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return h


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a row, and the index of each row's first (rows + 1 values).

    A row with fewer words, one at least, has its whole sequence as the only shingle; a row without words has none.
    """
    count = np.diff(first)
    whole = np.flatnonzero((count > 0) & (count < k))
    per = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    at = np.zeros(len(first), dtype=np.int64)
    np.cumsum(per, out=at[1:])
    total = int(at[-1])
    row = np.repeat(np.arange(len(per)), per)
    begin = first[:-1][row] + (np.arange(total) - at[:-1][row])
    acc = np.full(total, np.uint64(k), dtype=np.uint64)
    last = len(hashes) - 1
    for j in range(k):
        acc = mix(acc * _GOLD + hashes[np.minimum(begin + j, last)]) if total else acc
    for r in whole:
        value = np.array([count[r] + 1_000_003], dtype=np.uint64)
        for w in hashes[first[r] : first[r + 1]]:
            value = mix(value * _GOLD + w)
        acc[at[r]] = value[0]
    return acc, at


def distinct_sorted(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, ascending, with new row bounds."""
    if not len(values):
        return values, at
    values = values.copy()
    for r in range(len(at) - 1):
        if at[r + 1] - at[r] > 1:
            values[at[r] : at[r + 1]].sort()
    fresh = np.empty(len(values), dtype=bool)
    fresh[0], fresh[1:] = True, values[1:] != values[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    fresh[heads] = True
    count = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(fresh, out=count[1:])
    return values[fresh], count[at]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
