"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learned from document labels.

A sentence scores p = sigmoid(b + sum of the weights of its features).  A document scores 1 - (1 - p0) product(1 - q),
where p0 = sigmoid(b) counts once, for whatever no feature tells, and 1 - q = (1 - p) / (1 - p0), 1 at most, is what a
sentence adds: a single offending sentence is enough, sentences without a feature add nothing however many there are,
and clean ones do not make up for it.  Sentences with high p show where the offence is.  Features are words (lower
case, without punctuation) and their beginnings of 4 to 8 bytes.  Which are features, and their weights, are learned
from labelled documents of which at most ``sample`` are used, chosen by a hash of doc_id; scoring reads every whole
text.

Defined cases: a null or empty text is one sentence without features; labels that contradict each other count as
toxic; of a labelled doc_id with several texts the smallest teaches; without toxic labels every score is near 0;
repeated rows are scored one by one; a null doc_id is scored (held_out is false); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textvec as tv
from lodestrata.llm.runtime import Scratch, ship

#: Labelled documents that training uses at most, and features that a model has at most.
SAMPLE, FEATURES = 12_000, 512
BEGINNINGS = (4, 5, 6, 7, 8)
THRESHOLD = 0.3
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?\n")] = True


@dataclass
class Model:
    features: np.ndarray  # sorted 64-bit word hashes
    weights: np.ndarray
    bias: float


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows: (starts, ends, rows, sentences), and row bounds in sentences' numbers.

    Sentences are numbered over all rows; a row with k stops has k + 1, so that its first is its own.
    """
    starts, ends, at = tv.spans(_WORD[data], offs)
    stops = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_STOP[data], out=stops[1:])
    rows = len(offs) - 1
    row = np.repeat(np.arange(rows), np.diff(at))
    return starts, ends, row, stops[starts] + row, stops[offs] + np.arange(rows + 1)


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of words, 64-bit features): the words themselves, then their beginnings of each length."""
    data = tv.lower_ascii(data)
    yield np.arange(len(starts)), tv.hash_spans(data, starts, ends)
    for k in BEGINNINGS:
        longer = np.flatnonzero(ends - starts > k)
        yield longer, tv.hash_spans(data, starts[longer], starts[longer] + k) ^ np.uint64(0x517CC1B727220A95)


def _hits(h: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that are features: their places, and the features."""
    if not len(features) or not len(h):
        z = np.zeros(0, dtype=np.int64)
        return z, z
    f = np.minimum(np.searchsorted(features, h), len(features) - 1)
    hit = np.flatnonzero(features[f] == h)
    return hit, f[hit]


def _pairs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sentence: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (sentence, feature), sorted."""
    k = max(1, len(features))
    found = [np.zeros(0, dtype=np.int64)]
    for place, h in _features(data, starts, ends):
        hit, f = _hits(h, features)
        found.append(sentence[place[hit]] * k + f)
    pair = np.unique(np.concatenate(found))
    return pair // k, pair % k


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _adds(z: np.ndarray, bias: float) -> np.ndarray:
    """What sentences add to the exponent of a document's noisy-or."""
    return np.maximum(_softplus(z) - _softplus(bias), 0)


def fit(doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, y: np.ndarray, features: np.ndarray, steps: int = 400, decay: float = 2e-3) -> Model:
    """Weights by Adam on the log-likelihood of the noisy-or.

    ``doc``, ``sentence`` (numbers) and ``feature`` list each distinct feature of each sentence that has one; ``y`` is
    the label of each document.
    """
    key, own = np.unique(sentence, return_inverse=True)
    owner = np.zeros(len(key), dtype=np.int64)
    owner[own] = doc
    w, b = np.zeros(len(features)), -7.0
    m, v = np.zeros(len(features) + 1), np.zeros(len(features) + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(own, weights=w[feature], minlength=len(key))
        total = _softplus(b) + np.bincount(owner, weights=_adds(z, b), minlength=len(y))
        pull = np.where(y == 1, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1.0)
        counts = pull[owner] * (z >= b)
        gz, base = counts / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        grad = np.append(np.bincount(feature, weights=gz[own], minlength=len(w)), gz.sum() + (pull.sum() - counts.sum()) * base) / len(y)
        grad[:-1] += decay * w / max(1, len(w)) ** 0.5
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(features, w, float(b))


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, sample: int = SAMPLE, features: int = FEATURES, scratch: Scratch | None = None) -> Model:
    """A model from labels(doc_id, toxic) and docs(doc_id, text); ``use`` filters the labelled rows."""
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "toxicity")
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id is not null and toxic is not null")
    marked = (marked if use is None else marked.where(use)).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("y"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded: broadcast below
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scratch.keep(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")), "sample")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy()
            seen, of = [], []
            for first, data, offs in tv.chunks(batch.column(2)):
                starts, ends, row, _, _ = _words(data, offs)
                every = [(row[place], h) for place, h in _features(data, starts, ends)]
                r, h = np.concatenate([x for x, _ in every]), np.concatenate([x for _, x in every])
                order = np.lexsort((h, r))
                r, h = r[order], h[order]
                fresh = np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, dtype=bool)
                seen.append(h[fresh])
                of.append(y[r[fresh] + first])
            if seen:
                word, place = np.unique(np.concatenate(seen), return_inverse=True)
                y1 = np.bincount(place, weights=np.concatenate(of), minlength=len(word)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(y1), pa.array(np.bincount(place, minlength=len(word)) - y1)], names=["h", "n1", "n0"])

    size = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), -7.0 if not n1 else 7.0)
    words = rows.mapInArrow(tally, "h long, n1 long, n0 long").groupBy("h").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where("n1 + n0 >= 3")
    both = (F.col("n1") + F.col("n0")) / (n1 + n0)
    z = (F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(both * (1 - both) * (1 / n1 + 1 / n0) + 1e-12)
    best = words.orderBy(F.abs(z).desc(), "h").limit(features).select("h").collect()
    chosen_features = np.sort(np.array([r["h"] for r in best], dtype=np.int64).view(np.uint64))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offs in tv.chunks(batch.column(2)):
                rows = len(offs) - 1
                starts, ends, row, sentence, base = _words(data, offs)
                s, f = _pairs(data, starts, ends, sentence, chosen_features)
                cut = np.searchsorted(s, base)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, rows), pa.array([s[a:b] - n for a, b, n in zip(cut, cut[1:], base, strict=False)], type=pa.list_(pa.int64())), pa.array([f[a:b] for a, b in zip(cut, cut[1:], strict=False)], type=pa.list_(pa.int64()))], names=["y", "s", "f"])

    got = rows.mapInArrow(spread, "y long, s array<long>, f array<long>").toArrow()  # at most ``sample`` rows
    scratch.drop("sample")
    y = got.column("y").to_numpy()
    size = np.array([len(x) for x in got.column("s").to_pylist()], dtype=np.int64)
    s, f = (np.concatenate([np.zeros(0, dtype=np.int64), *(c.flatten().to_numpy() for c in got.column(k).chunks)]).astype(np.int64) for k in ("s", "f"))
    doc = np.repeat(np.arange(len(y)), size)
    top = int(s.max()) + 1 if len(s) else 1
    return fit(doc, doc * top + s, f, y, chosen_features)


def score_arrays(model: Model, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every row: score, best sentence score, and the place of that sentence (start, end in code points)."""
    rows = len(offs) - 1
    starts, ends, row, sentence, base = _words(data, offs)
    s, f = _pairs(data, starts, ends, sentence, model.features)
    key, own = np.unique(s, return_inverse=True)
    z = model.bias + np.bincount(own, weights=model.weights[f], minlength=len(key)) if len(key) else np.zeros(0)
    of = np.searchsorted(base, key, side="right") - 1
    total = _softplus(model.bias) + np.bincount(of, weights=_adds(z, model.bias), minlength=rows)[:rows]
    best = np.full(rows, -1, dtype=np.int64)
    order = np.lexsort((-np.arange(len(z)), z))
    best[of[order]] = order  # the last written is the best
    top = np.full(rows, 1 / (1 + np.exp(-model.bias)))
    start, end = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
    have = np.flatnonzero(best >= 0)
    if len(have):
        top[have] = 1 / (1 + np.exp(-z[best[have]]))
        stops = np.flatnonzero(_STOP[data])
        nth = key[best[have]] - have  # stops before the sentence, over all rows
        a = np.where(nth > 0, np.append(stops, 0)[nth - 1] + 1, 0)
        a = np.maximum(a, offs[have])
        b = np.minimum(np.append(stops, len(data))[nth] + 1, offs[have + 1])
        points = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        start[have], end[have] = points[a] - points[offs[have]], points[b] - points[offs[have]]
    return -np.expm1(-total), top, start, end


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, and the most offending sentence: its score and its place (code points)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offs in tv.chunks(batch.column(1)):
                p, top, a, b = score_arrays(model, data, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(p)), pa.array(np.clip(p, 0.0, 1.0)), pa.array((p >= threshold).astype(np.int32)), pa.array(top), pa.array(a), pa.array(b)], names=["doc_id", "score", "predicted", "sentence_score", "sentence_start", "sentence_end"])

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, score double, predicted int, sentence_score double, sentence_start long, sentence_end long")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows whose labels are not learned from; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted toxic."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offs in tv.chunks(batch.column(at)):
                p, _, _, _ = score_arrays(model, data, offs)
                yield batch.slice(first, len(p)).filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)
