"""BPE with word ends: encoding and decoding, merges by a contiguous rank array.

Texts are brought to NFC and lower case by the library's own tables (whose Unicode is newer than Python's) and cut
into words, and each distinct word is merged once a worker: its part boundaries and the ranks of adjacent parts lie in
two short lists; the smallest rank is found by scanning, its boundary is deleted, and the two neighbouring ranks are
looked up again.  Words of over LONG_WORD bytes, for which
scanning is quadratic, take the same merges from a heap instead.  Whole texts are encoded, then decoded (the parts,
with a space between).

Defined cases: a null text is empty and has no ids; added strings of the vocabulary file inside a text become their
own ids, as in the library; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import subwords as sw
from lodestrata.llm import textvec as tv
from lodestrata.llm.runtime import ship

LONG_WORD = 256
_NONE = 1 << 60


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else 256, 257, ... in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


def _decoded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points, and row bounds in code points."""
    place = np.flatnonzero((data & 0xC0) != 0x80)
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4"), np.searchsorted(place, offs)


class WordBPE:
    """A vocabulary file of the kind BPE with an end-of-word suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.spelling = [""] * (max(vocab.values()) + 1)
        for text, i in vocab.items():
            self.spelling[i] = text
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.added.items():
            self.spelling.extend([""] * (i + 1 - len(self.spelling)))
            self.spelling[i] = text
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pairs.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        letters = byte_letters()
        self.inner, self.final = [vocab[x] for x in letters], [vocab[x + end] for x in letters]
        self.spelt = [s.encode() + b" " for s in self.spelling]
        self.table = sw.WordTable(lambda found: [self.word(w) for w in found], lambda ids: b"".join([self.spelt[i] for i in ids]))
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def word(self, text: bytes) -> list[int]:
        parts = [self.inner[b] for b in text[:-1]] + [self.final[text[-1]]]
        return self.scan(parts) if len(parts) <= LONG_WORD else self.heap(parts)

    def scan(self, parts: list[int]) -> list[int]:
        get, none = self.pairs.get, (_NONE, 0)
        ranks = [get(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best[0] == _NONE:
                break
            i = ranks.index(best)
            parts[i] = best[1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | parts[i], none)
            if i < len(ranks):
                ranks[i] = get(parts[i] << 32 | parts[i + 1], none)
        return parts

    def heap(self, parts: list[int]) -> list[int]:
        get, n = self.pairs.get, len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(p[0], i, parts[i], parts[i + 1], p[1]) for i in range(n - 1) if (p := get(parts[i] << 32 | parts[i + 1]))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (p := get(parts[x] << 32 | parts[y])):
                    heapq.heappush(queue, (p[0], x, parts[x], parts[y], p[1]))
        return [p for p, a in zip(parts, alive, strict=True) if a]

    @staticmethod
    def normal(column: pa.Array) -> pa.Array:
        """NFC, then lower case character by character, both as in the library."""
        column = pc.fill_null(column, "")
        data, offs = tv.buffers(column)
        if not len(data) or data.max() < 128:
            return pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(offs), pa.py_buffer(tv.lower_ascii(data))])
        table, several = sw.lower_table()
        code, rows = _decoded(data, offs)
        rough = sw.unsettled()[code]
        for x in several:
            rough |= code == ord(x)
        if rough.any():  # rows with such characters go to the library, the others are as they should be
            from tokenizers import normalizers

            form = normalizers.NFC().normalize_str
            texts = column.to_pylist()
            for r in np.unique(np.searchsorted(rows, np.flatnonzero(rough), side="right") - 1).tolist():
                texts[r] = form(texts[r])
                for x, lower in several.items():
                    texts[r] = texts[r].replace(x, lower)
            code, rows = _decoded(*tv.buffers(pa.array(texts, type=pa.large_string())))
        code = table[code]
        size = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        bound = np.zeros(len(code) + 1, dtype=np.int64)
        np.cumsum(size, out=bound[1:])
        return pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(bound[rows]), pa.py_buffer(code.tobytes().decode("utf-32-le").encode("utf-8"))])

    def plain(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for first, raw, offs in tv.chunks(column):
            part = pa.Array.from_buffers(pa.large_string(), len(offs) - 1, [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(raw))])
            data, at = tv.buffers(self.normal(part))
            yield first, *sw.encode_chunk(data, at, sw.cut_plain, self.table, spelt=True)

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, list[np.ndarray], list[bytes]]]:
        """(first row, ids of each row, decoded bytes of each row) for chunks of rows."""
        for first, ids, at, text, o in self.plain(column):
            rows = len(at) - 1
            own = [ids[at[r] : at[r + 1]] for r in range(rows)]
            spelt = [text[o[r] : max(o[r], o[r + 1] - 1)].tobytes() for r in range(rows)]
            if self.special:
                part = column.slice(first, rows)
                hit = np.zeros(rows, dtype=bool)
                for a in self.added:
                    hit |= pc.fill_null(pc.match_substring(part, a), False).to_numpy(zero_copy_only=False)
                for r in np.flatnonzero(hit):
                    own[r] = self.mixed(part[int(r)].as_py())
                    spelt[r] = b" ".join(self.spelling[i].encode() for i in own[r])
            yield first, own, spelt

    def mixed(self, text: str) -> np.ndarray:
        """Ids of a text with added strings in it, which are found before anything else is done."""
        out, last = [], 0
        for m in [*self.special.finditer(text), None]:
            for _, ids, _, _, _ in self.plain(pa.array([text[last : m.start() if m else len(text)]], type=pa.string())):
                out.append(ids)
            if m:
                out.append(np.array([self.added[m[0]]], dtype=np.uint32))
                last = m.end()
        return np.concatenate(out).astype(np.uint32) if out else np.zeros(0, dtype=np.uint32)


_loaded: dict[str, WordBPE] = {}


def vocabulary(path: str) -> WordBPE:
    """The vocabulary, kept in the worker."""
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, and either ids (binary, unsigned 32-bit) and decoded (string) or, with ``digests``, their
    SHA-256, computed beside them so that they need not leave the worker."""
    ship(docs.sparkSession)
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        bpe.table.begin(run_id)
        for batch in batches:
            for first, own, spelt in bpe.encode_column(batch.column(1)):
                raw = [x.astype("<u4").tobytes() for x in own]
                if digests:
                    last = [pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array([hashlib.sha256(x).hexdigest() for x in spelt])]
                else:
                    last = [pa.array(raw, type=pa.binary()), pa.array([x.decode("utf-8") for x in spelt])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(own)), pa.array([len(x) for x in own], type=pa.int64()), *last], names=["doc_id", "n_tokens", "a", "b"])

    names = ("ids_sha256 string", "decoded_sha256 string") if digests else ("ids binary", "decoded string")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = source.mapInArrow(run, f"doc_id long, n_tokens long, a {names[0].split()[1]}, b {names[1].split()[1]}")
    return out.withColumnsRenamed({"a": names[0].split()[0], "b": names[1].split()[0]})
