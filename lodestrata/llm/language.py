"""Language identification by mixture inference: each document's proportions of languages, by expectation-maximisation.

A text is its counts of byte trigrams (letters in lower case, everything between words one space), in 2^14 buckets.
Each learned language gives every trigram a probability; expectation-maximisation finds the proportions under which
the mixture makes the text likeliest.  The set of languages is then chosen by penalised likelihood: of the sets of
the most proportioned one, two, three ... languages, each fitted again, the one with the best likelihood less a penalty
for each further language.  Sets hold languages with a proportion of ``least`` or more among all (0: any number).  The prediction is the largest proportion in that set, and the score is that proportion.

Learning uses at most ``sample`` documents a language, chosen by a hash; prediction reads every whole text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and no proportions; a language that is
null teaches nothing; without any teaching rows all texts are ``und``; repeated rows and null doc_ids are predicted
like others (a null doc_id is not held out and not learned from); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm import subwords as sw
from lodestrata.llm import textvec as tv
from lodestrata.llm.runtime import Scratch, ship

SAMPLE, BITS, STEPS = 1000, 14, 10
#: Proportion among all languages that a language of a chosen set has at least.
LEAST = 0.002
#: Ranges of the hash by which rows are counted: 2 to this power.
RANGE_BITS = 14
#: Nats that a further language must gain, times the logarithm of the number of trigrams (which overlap threefold).
PENALTY = 6.0
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    chance: np.ndarray  # buckets x languages


def trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every byte trigram within a row that touches a letter in its middle or at its end."""
    n = len(data)
    if n < 3:
        z = np.zeros(0, dtype=np.int64)
        return z, z
    f = _FOLD[data].astype(np.uint32)
    code = (f[:-2] << 16 | f[1:-1] << 8 | f[2:]) * np.uint32(2654435761)
    ok = f[1:-1] != 32
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    ok &= row[2:] == row[:-2]
    return row[:-2][ok], (code[ok] >> np.uint32(32 - BITS)).astype(np.int64)


def letters(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each row has a letter."""
    if not len(data) or data.max() < 128:
        is_letter, at = ((data | 32) >= 97) & ((data | 32) <= 122), offs
    else:
        place = np.flatnonzero((data & 0xC0) != 0x80)
        is_letter = sw.classes()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4")] == sw.LETTER
        at = np.searchsorted(place, offs)
    seen = np.zeros(len(is_letter) + 1, dtype=np.int64)
    np.cumsum(is_letter, out=seen[1:])
    return seen[at[1:]] > seen[at[:-1]]


def choose(labelled: DataFrame, sample: int) -> DataFrame:
    """(i, lang): the ``sample`` rows of each language that are first by hash, of labelled(i, lang).

    A count by ranges of the hash (combined map-side) tells up to which range a language needs rows, so only those are
    sorted: one task never gets all rows of a frequent language, nor ``sample`` rows from every other task.
    """
    h = F.xxhash64("i")
    ranged = labelled.withColumn("range", F.shiftright(h, 64 - RANGE_BITS))
    sizes = ranged.groupBy("lang", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    needed = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < sample)
    last = needed.groupBy("lang").agg(F.max("range").alias("last"))  # one row a language, like the model
    some = ranged.join(F.broadcast(last), "lang").where("range <= last")
    order = Window.partitionBy("lang").orderBy(h, "i")
    return some.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("i", "lang")


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from rows whose language is known; at most ``sample`` documents a language are read."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("lang is not null and text is not null")
    scratch = Scratch(docs.sparkSession, "language")
    ids = choose(scratch.keep(rows.select("i", "lang"), "labelled"), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for first, data, offs in tv.chunks(batch.column(0)):
                row, g = trigrams(data, offs)
                of, name = np.unique(batch.column(1).slice(first, len(offs) - 1).to_pylist(), return_inverse=True)[::-1]
                for k, x in enumerate(name.tolist()):
                    total[x] = total.get(x, 0) + np.bincount(g[of[row] == k], minlength=1 << BITS)
        for x, t in total.items():
            some = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(some)), pa.array(some), pa.array(t[some])], names=["lang", "g", "n"])

    chosen = rows.join(F.broadcast(ids.distinct()), ["i", "lang"]).select("text", "lang")  # sample rows a language
    counts = chosen.mapInArrow(run, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")).toArrow()
    scratch.drop("labelled")
    names = sorted(set(counts.column("lang").to_pylist()))
    table = np.full((1 << BITS, len(names)), 0.5)
    if names:
        np.add.at(table, (counts.column("g").to_numpy(), np.searchsorted(names, counts.column("lang").to_pylist())), counts.column("n").to_numpy())
    return Model(names, table / table.sum(axis=0, keepdims=True))


def _mix(chance: np.ndarray, c: np.ndarray, head: np.ndarray, row: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after ``steps`` rounds, and the log-likelihood of each row before the last."""
    total = np.add.reduceat(c, head)[:, None]
    for _ in range(steps):
        part = chance * share[row]
        whole = part.sum(axis=1)
        share = np.add.reduceat(part * (c / whole)[:, None], head, axis=0) / total
    return share, np.add.reduceat(c * np.log(whole), head)


def infer(model: Model, data: np.ndarray, offs: np.ndarray, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (rows x languages) under the chosen set, and whether the row has any (a letter and a trigram)."""
    rows, size = len(offs) - 1, len(model.languages)
    share = np.zeros((rows, size))
    known = letters(data, offs)
    if not size:
        return share, np.zeros(rows, dtype=bool)
    row, g = trigrams(data, offs)
    some = np.bincount(row * np.int64(1 << BITS) + g, minlength=0) if rows <= 512 else None
    if some is None:
        cell, c = np.unique(row * np.int64(1 << BITS) + g, return_counts=True)
    else:
        cell = np.flatnonzero(some)
        c = some[cell]
    row, g = cell >> BITS, cell & ((1 << BITS) - 1)
    c = c.astype(np.float64)
    share[known] = 1 / size  # a row with letters but without trigrams stays undecided
    if len(cell):
        there, own = np.unique(row, return_inverse=True)
        head = np.searchsorted(row, there)
        chance = model.chance[g]
        full, _ = _mix(chance, c, head, own, np.full((len(there), size), 1 / size), STEPS)
        order = np.argsort(-full, axis=1, kind="stable")
        grams = np.add.reduceat(c, head)
        best, chosen = np.full(len(there), -np.inf), np.zeros_like(full)
        width = np.maximum((full >= least).sum(axis=1), 1)
        some, cells = np.arange(len(there)), np.arange(len(c))
        for m in range(1, int(width.max()) + 1):
            keep = width[some] >= m  # rows that have sets of this size
            if not keep.all():
                cells = cells[width[own[cells]] >= m]
                some = some[keep]
            inner = np.searchsorted(some, own[cells])
            start = np.zeros((len(some), size))
            np.put_along_axis(start, order[some, :m], np.take_along_axis(full[some], order[some, :m], axis=1) + 1e-6, axis=1)
            now, like = _mix(chance[cells], c[cells], np.searchsorted(inner, np.arange(len(some))), inner, start / start.sum(axis=1, keepdims=True), 1 if m == 1 else 5)
            worth = like - PENALTY * (m - 1) * np.log(grams[some] + 1)
            better = worth > best[some]
            best[some[better]], chosen[some[better]] = worth[better], now[better]
        share[there] = chosen
    share[~known] = 0
    return share, known


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, lang_pred, score, languages (the chosen set with proportions, largest first)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"])
        for batch in batches:
            for first, data, offs in tv.chunks(batch.column(1)):
                share, known = infer(model, data, offs, least)
                top = np.where(known, share.argmax(axis=1) if share.shape[1] else 0, len(names) - 1)
                score = np.where(known, share.max(axis=1) if share.shape[1] else 0.0, 0.0)
                sets = [";".join(f"{names[k]}:{s[k]:.3f}" for k in np.argsort(-s, kind="stable") if s[k] > 0) for s in share]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(top)), pa.array(names[top].tolist(), type=pa.string()), pa.array(score), pa.array(sets)], names=["doc_id", "lang_pred", "score", "languages"])

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double, languages string")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def teaching(doc_id: str = "doc_id") -> Column:
    """Rows that may be learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) != 0, F.lit(False))


def keep(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that have a language with a proportion of ``least`` or more."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offs in tv.chunks(batch.column(at)):
                share, known = infer(model, data, offs)
                good = known & ((share.max(axis=1) if share.shape[1] else np.zeros(len(share))) >= least)
                yield batch.slice(first, len(good)).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
