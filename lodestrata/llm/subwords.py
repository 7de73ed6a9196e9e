"""Whole-text encoding through distinct words: cut, find the distinct words of a chunk, encode each once, gather.

Words of natural text repeat, so a worker encodes each distinct word once, keeps it in a bounded table, and turns
texts into ids by array lookups.  Cutting is done on arrays of character classes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from lodestrata.llm import textvec as tv

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
_TABLE_SIZE = 0x110000

#: The endings that the cutting patterns take with an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

#: Ranges of code points that may have a class, a lower case or a composition: planes 0 to 3, and tags and selectors.
ASSIGNED = ((1, 0xD800), (0xE000, 0x40000), (0xE0000, 0xE1000))

_classes: np.ndarray | None = None
_lower: tuple[np.ndarray, dict[str, str]] | None = None
_unsettled: np.ndarray | None = None


def _points() -> list[int]:
    return [c for a, b in ASSIGNED for c in range(a, b)]


def classes() -> np.ndarray:
    """The class of each code point, as the library's patterns see it (its Unicode tables are newer than Python's)."""
    global _classes
    if _classes is None:
        from tokenizers import Regex, pre_tokenizers

        points = np.array(_points())
        text = "".join(map(chr, points))
        table = np.zeros(_TABLE_SIZE, dtype=np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
                table[points[a:b]] = kind
        _classes = table
    return _classes


def lower_table() -> tuple[np.ndarray, dict[str, str]]:
    """The library's lower case: one-to-one as a table, and the characters that become several."""
    global _lower
    if _lower is None:
        from tokenizers import normalizers

        points = _points()
        found = normalizers.Lowercase().normalize_str("\0".join(map(chr, points))).split("\0")
        table = np.arange(_TABLE_SIZE, dtype=np.uint32)
        table[points] = [ord(x) if len(x) == 1 else c for c, x in zip(points, found, strict=True)]
        _lower = table, {chr(c): x for c, x in zip(points, found, strict=True) if len(x) != 1}
    return _lower


def unsettled() -> np.ndarray:
    """Code points (flags) that may change, or join with others, when a text is brought to the normal form NFC.

    A text without any is in that form: all its characters are starters that no earlier character takes up.
    """
    global _unsettled
    if _unsettled is None:
        from tokenizers import normalizers

        points = _points()
        found = normalizers.NFC().normalize_str("\0".join(map(chr, points))).split("\0")
        flags = np.ones(_TABLE_SIZE, dtype=bool)
        flags[0] = False
        flags[points] = [x != chr(c) or unicodedata.combining(chr(c)) != 0 or unicodedata.category(chr(c)) == "Cn" for c, x in zip(points, found, strict=True)]
        taken = [int(d.split()[1], 16) for c in points if len((d := unicodedata.decomposition(chr(c))).split()) == 2 and d[0] != "<"]
        flags[[*taken, *range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]] = True  # the last: vowels and finals of Hangul
        _unsettled = flags
    return _unsettled


def _contractions(code: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
    """Corrects ``start`` (flags of word starts) around apostrophes that begin a word."""
    at = np.flatnonzero((code == 39) & start)
    if not len(at):
        return
    n = len(code)
    room = stop[at] if len(stop) else None
    taken = np.zeros(len(at), dtype=np.int64)
    for e in ENDINGS:
        fits = (taken == 0) & (at + len(e) < room)
        for j, ch in enumerate(e):
            fits &= code[np.minimum(at + 1 + j, n - 1)] == ord(ch)
        taken[fits] = len(e)
    at, taken = at[taken > 0], taken[taken > 0]
    for j in (1, 2):
        inside = at[taken >= j] + j
        start[inside] = False
    after = at + taken + 1
    start[after[after < n]] = True


def _codes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Code points, the byte place of each (None: ASCII, places are indexes), and row bounds in code points."""
    if not len(data) or data.max() < 128:
        return data, None, offs
    place = np.flatnonzero((data & 0xC0) != 0x80)
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4")
    return code, place, np.searchsorted(place, offs)


def _row_ends(n: int, rows: np.ndarray) -> np.ndarray:
    return np.repeat(rows[1:], np.diff(rows)) if n else np.zeros(0, dtype=np.int64)


def _bytes_at(index: np.ndarray, place: np.ndarray | None, total: int) -> np.ndarray:
    if place is None:
        return index
    return np.append(place, total)[index]


def cut_spaced(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Words that carry one leading space; white space is kept.  (word bounds in bytes, row bounds in words, kept)."""
    code, place, rows = _codes(data, offs)
    n = len(code)
    kind = classes()[code]
    start = np.empty(n, dtype=bool)
    if n:
        start[0], start[1:] = True, kind[1:] != kind[:-1]
    heads = rows[:-1][rows[:-1] < rows[1:]]
    start[heads] = True
    first_of_row = np.zeros(n + 1, dtype=bool)
    first_of_row[rows] = True
    # the last character of white space that text follows goes with that text if it is a space, else stands alone
    follows = np.flatnonzero(start & (kind != SPACE) & ~first_of_row[:-1])
    follows = follows[kind[follows - 1] == SPACE]
    start[follows - 1] = True
    start[follows[code[follows - 1] == 32]] = False
    _contractions(code, start, _row_ends(n, rows))
    at = np.flatnonzero(start)
    return np.append(_bytes_at(at, place, len(data)), len(data)), np.searchsorted(at, rows), None


def cut_plain(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Words of letters, single numerals, runs of other characters; white space is marked as not kept."""
    code, place, rows = _codes(data, offs)
    n = len(code)
    kind = classes()[code]
    start = np.empty(n, dtype=bool)
    if n:
        start[0], start[1:] = True, (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    heads = rows[:-1][rows[:-1] < rows[1:]]
    start[heads] = True
    _contractions(code, start, _row_ends(n, rows))
    at = np.flatnonzero(start)
    return np.append(_bytes_at(at, place, len(data)), len(data)), np.searchsorted(at, rows), kind[at] != SPACE


class Growing:
    """An array that grows at its end; room is doubled when it runs out."""

    def __init__(self, kind: type) -> None:
        self.room, self.size = np.zeros(1024, dtype=kind), 0

    def add(self, more: np.ndarray) -> None:
        need = self.size + len(more)
        if need > len(self.room):
            room = np.zeros(max(need, 2 * len(self.room)), dtype=self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : need] = more
        self.size = need

    @property
    def now(self) -> np.ndarray:
        return self.room[: self.size]


class WordTable:
    """Ids (and the decoded bytes, if asked for) of distinct words, found by a 64-bit hash in an open-addressed table.

    It is emptied when it would hold more than ``limit`` words, so a worker's memory is bounded.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], spell: Callable[[list[int]], bytes] | None = None, limit: int = 1_500_000) -> None:
        self.encode, self.spell, self.limit = encode, spell, limit
        self.mask = (1 << (2 * limit - 1).bit_length()) - 1
        self.run: str | None = None
        self.clear()

    def begin(self, run: str | None) -> None:
        """Forgets the words of another run: no run profits from what earlier ones left in a worker."""
        if run != self.run:
            self.run = run
            self.clear()

    def clear(self) -> None:
        self.key, self.slot, self.count = np.zeros(self.mask + 1, dtype=np.uint64), np.zeros(self.mask + 1, dtype=np.int32), 0
        self._at, self._flat = Growing(np.int64), Growing(np.uint32)
        self._spelt_at, self._spelt = Growing(np.int64), Growing(np.uint8)
        self._at.add(np.zeros(1, dtype=np.int64))
        self._spelt_at.add(np.zeros(1, dtype=np.int64))

    @property
    def at(self) -> np.ndarray:
        return self._at.now

    @property
    def flat(self) -> np.ndarray:
        return self._flat.now

    def _find(self, h: np.ndarray) -> np.ndarray:
        place = (h & np.uint64(self.mask)).astype(np.int64)
        seen = self.key[place]
        out = np.where(seen == h, self.slot[place], -1)
        todo = np.flatnonzero((seen != h) & (seen != 0))
        place = place[todo]
        while len(todo):
            place = (place + 1) & self.mask
            seen = self.key[place]
            hit = seen == h[todo]
            out[todo[hit]] = self.slot[place[hit]]
            go = ~hit & (seen != 0)
            todo, place = todo[go], place[go]
        return out

    def _insert(self, h: np.ndarray) -> None:
        slot = np.arange(self.count, self.count + len(h), dtype=np.int32)
        place = (h & np.uint64(self.mask)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.key[place] == 0)
            _, one = np.unique(place[free], return_index=True)
            done = free[one]
            self.key[place[done]], self.slot[place[done]] = h[done], slot[done]
            rest = np.ones(len(h), dtype=bool)
            rest[done] = False
            h, slot, place = h[rest], slot[rest], (place[rest] + 1) & self.mask
        self.count = len(self.at) - 1

    def slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each word (a byte span of ``data``) in ``at`` and ``spelt``."""
        h = tv.hash_spans(data, starts, ends)
        h[h == 0] = 1
        out = self._find(h)
        lost = np.flatnonzero(out < 0)
        if len(lost):
            new, one = np.unique(h[lost], return_index=True)
            if self.count + len(new) > self.limit and self.count:
                self.clear()
                return self.slots(data, starts, ends)
            if len(new) > self.limit:  # one chunk alone holds more: the table grows for it
                self.mask = (1 << (2 * len(new)).bit_length()) - 1
                self.clear()
                self.limit = len(new)
                return self.slots(data, starts, ends)
            raw = data.tobytes()
            ids = self.encode([raw[a:b] for a, b in zip(starts[lost[one]].tolist(), ends[lost[one]].tolist(), strict=True)])
            size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            self._at.add(self.at[-1] + np.cumsum(size))
            self._flat.add(np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(size.sum())))
            if self.spell:
                texts = [self.spell(x) for x in ids]
                self._spelt_at.add(self._spelt_at.now[-1] + np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))))
                self._spelt.add(np.frombuffer(b"".join(texts), dtype=np.uint8))
            self._insert(new)
            out[lost] = self._find(h[lost])
        return out.astype(np.int64)

    def spellings(self) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(self._spelt_at.now) - 1, [None, pa.py_buffer(self._spelt_at.now), pa.py_buffer(self._spelt.now)])


def encode_chunk(data: np.ndarray, offs: np.ndarray, cut: Callable, table: WordTable, spelt: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Ids of all rows one after the other and row bounds; with ``spelt`` also the decoded bytes and their bounds."""
    bounds, rows, kept = cut(data, offs)
    starts, ends = bounds[:-1], bounds[1:]
    if kept is not None:
        seen = np.zeros(len(kept) + 1, dtype=np.int64)
        np.cumsum(kept, out=seen[1:])
        rows, starts, ends = seen[rows], starts[kept], ends[kept]
    if not len(starts):
        zero = np.zeros(len(offs), dtype=np.int64)
        return np.zeros(0, dtype=np.uint32), zero, np.zeros(0, dtype=np.uint8), zero
    slot = table.slots(data, starts, ends)
    size = table.at[slot + 1] - table.at[slot]
    ids = table.flat[tv.gather(table.at[slot], size)]
    bound = np.zeros(len(slot) + 1, dtype=np.int64)
    np.cumsum(size, out=bound[1:])
    if not spelt:
        return ids, bound[rows], None, None
    text = table.spellings().take(pa.array(slot))
    _, o, d = text.buffers()
    o = np.frombuffer(o, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(d, dtype=np.uint8) if d is not None and d.size else np.zeros(0, dtype=np.uint8)
    return ids, bound[rows], raw, o[rows]


# --- byte-level vocabulary, ids by the tokenizers library -----------------------------------------------------------

_byte_level: dict[str, tuple] = {}


def byte_level(path: str) -> tuple:
    """(tokenizer, word table, added strings) of a byte-level vocabulary file, kept in the worker."""
    if path not in _byte_level:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        added = [t.content.encode() for t in tok.get_added_tokens_decoder().values()]

        def encode(found: list[bytes]) -> list[list[int]]:
            return [e.ids for e in tok.encode_batch_fast([w.decode("utf-8") for w in found], add_special_tokens=False)]

        _byte_level[path] = tok, WordTable(encode), added
    return _byte_level[path]


def _free_of(data: np.ndarray, offs: np.ndarray, added: list[bytes]) -> np.ndarray:
    """Rows (flags) in which no added string occurs."""
    free = np.ones(len(offs) - 1, dtype=bool)
    raw = data.tobytes()
    for a in added:
        at = raw.find(a)
        while at >= 0:
            free[np.searchsorted(offs, at, side="right") - 1] = False
            at = raw.find(a, at + 1)
    return free


def largest_id(path: str, *more: int) -> int:
    """The largest id of a vocabulary file, or of ``more``."""
    return max(*byte_level(path)[0].get_vocab(with_added_tokens=True).values(), *more)


def byte_level_ids(column: pa.Array, path: str, run: str | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, row bounds) for chunks of a string column, exactly as the library encodes the whole texts.

    The worker's table of words lives as long as calls name the same ``run``.
    """
    tok, table, added = byte_level(path)
    table.begin(run)
    for first, data, offs in tv.chunks(column):
        ids, at, _, _ = encode_chunk(data, offs, cut_spaced, table)
        free = _free_of(data, offs, added)
        if not free.all():  # added strings are matched before words are cut: the library itself encodes those texts
            parts = [ids[at[r] : at[r + 1]] if free[r] else np.array(tok.encode(data[offs[r] : offs[r + 1]].tobytes().decode("utf-8"), add_special_tokens=False).ids, dtype=np.uint32) for r in range(len(free))]
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts) if parts else ids
        yield first, ids, at
