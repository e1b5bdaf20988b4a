"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in its
words; the document's is the noisy-or of its sentences, 1 - prod(1 - p). Only
documents carry labels: the weights maximise their likelihood under the
noisy-or, so that the blame for a label falls on the sentences that explain
it, which then can be pointed at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from .training import SAMPLE, features, held_out, sample
from .words import LOWER, NOT_CORE, Slice, Words, hash_spans, slices, stream, words

BITS = 20  #: of a feature's number
#: A word stands for itself or, where that tells more, for one of its beginnings of so many bytes (inflected words share them).
STEMS = (4, 5, 6)
_STEM = stream(21, 1)[0]
_ENDS = np.array([chr(b) in ".!?\n" for b in range(256)])


def sentence_words(s: Slice) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words (runs of letters, digits and other scripts), their features (a row of the array for each), and the sentence of each.

    Sentences are numbered through the slice; one ends at a full stop,
    question or exclamation mark, line end or text end.
    """
    w = words(s, NOT_CORE)
    if not len(w.start):
        return w, np.zeros((0, 1 + len(STEMS)), np.int64), w.start
    spans = [w.end, *(np.minimum(w.start + n, w.end) for n in STEMS)]
    lower = LOWER[s.data]
    # a beginning that is the whole word hashes as the word does, and counts once
    feature = np.stack([(hash_spans(lower, w.start, e) ^ (_STEM * (e < w.end))) >> np.uint64(64 - BITS) for e in spans], axis=1).astype(np.int64)
    ends = np.zeros(len(s.data) + 1, np.int32)
    np.cumsum(_ENDS[s.data], dtype=np.int32, out=ends[1:])
    new = np.zeros(len(w.start), bool)
    new[1:] = (ends[w.start[1:]] > ends[w.end[:-1]]) | (w.row[1:] != w.row[:-1])
    return w, feature, np.cumsum(new)


def _tokens(s: Slice) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """``sentence_words`` with, last, which of them are the first of their word in their sentence (a word counts once there)."""
    w, feature, sentence = sentence_words(s)
    if not len(feature):
        return w, feature, sentence, w.start
    return w, feature, sentence, np.unique((sentence << BITS) | feature[:, 0], return_index=True)[1]


def _per_row(column: pa.Array) -> Iterator[np.ndarray]:
    """Of each row the features of each sentence's words, one word after the other; a sentence's end is a word of -1."""
    for s in slices(column):
        w, feature, sentence, once = _tokens(s)
        if not len(feature):
            yield from [np.zeros(0, np.int64)] * s.rows
            continue
        of, row = sentence[once], w.row[once]
        at = np.flatnonzero(np.append(of[1:] != of[:-1], True)) + 1
        marked = np.insert(feature[once], at, -1, axis=0)
        rows = np.insert(row, at, row[at - 1])
        yield from (x.ravel() for x in np.split(marked, np.searchsorted(rows, np.arange(1, s.rows))))


def telling(feature: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word the one of its features that tells most for the label, and whether any does."""
    known = order[feature]
    best = known.argmax(axis=1)
    at = np.arange(len(feature))
    return feature[at, best], known[at, best] > 0


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    order: np.ndarray  #: how much a feature tells, 0 for those that have no weight

    def sentences(self, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each sentence: row, start and end (bytes of the slice), probability."""
        w, feature, sentence = sentence_words(s)
        if not len(feature):
            return w.row, w.start, w.end, np.zeros(0)
        first = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1]))
        pick, known = telling(feature, self.order)
        key = np.unique((sentence[known] << BITS) | pick[known])
        z = np.bincount(key >> BITS, weights=self.weights[key & ((1 << BITS) - 1)], minlength=len(first)) + self.bias
        return w.row[first], w.start[first], w.end[np.append(first[1:], len(sentence)) - 1], 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def score(self, s: Slice) -> np.ndarray:
        row, _, _, p = self.sentences(s)
        return noisy_or(row, p, s.rows)


def noisy_or(row: np.ndarray, p: np.ndarray, rows: int) -> np.ndarray:
    """1 - prod(1 - p) over the sentences of each row, 0 for a row without any."""
    return -np.expm1(np.bincount(row, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=rows))


def fit(rows: list[tuple[int, np.ndarray]], least: int = 4, alpha: float = 2.0, gain: float = 3.0, rounds: int = 200, ridge: float = 0.3) -> Model:
    """From labels and marked words of each row.

    Every feature in at least ``least`` documents whose log odds (``alpha``
    documents of the usual mix added) are ``gain`` over the label's own gets
    a weight: at first what brings a sentence with it alone to these odds,
    to which the ridge draws it back in the gradient steps. With one class
    only the score is near that class's, with no rows it is about one half.
    """
    size, kinds = 1 << BITS, 1 + len(STEMS)
    y = np.array([bool(label) for label, _ in rows])
    if not len(y) or y.all() or not y.any():
        return Model(np.zeros(size), 0.0 if not len(y) else (4.0 if y[0] else -6.0), np.zeros(size))
    p, q = np.zeros(size), np.zeros(size)
    for (_, f), label in zip(rows, y, strict=True):
        (p if label else q)[np.unique(f[f >= 0])] += 1
    base = y.mean()
    odds = np.log((p + alpha * base) / (q + alpha * (1 - base)))
    order = np.where((p + q >= least) & (odds > np.log(base / (1 - base)) + gain), odds + 100, 0.0)
    sentence, column, bag = [], [], []
    k = 0
    for d, (_, f) in enumerate(rows):
        f = f.reshape(-1, kinds)
        ends = f[:, 0] < 0
        own = k + np.cumsum(ends) - ends
        pick, known = telling(f[~ends], order)
        key = np.unique((own[~ends][known] << BITS) | pick[known])
        sentence.append(key >> BITS)
        column.append(key & (size - 1))
        n = int(ends.sum())
        bag.append(np.full(n, d))
        k += n
    sentence, column, bag = np.concatenate(sentence), np.concatenate(column), np.concatenate(bag)
    chosen, column = np.unique(column, return_inverse=True)
    b = float(np.log(0.05 * len(y) / max(1, k)))
    first = np.maximum(odds[chosen] - b, 0)
    w = first.copy()
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(sentence, weights=w[column], minlength=k) + b
        s = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        hazard = np.bincount(bag, weights=np.logaddexp(0, z), minlength=len(y))
        # d log-likelihood / dz: -s in clean documents, s (1 - P) / P in others, 1 - P = exp(-hazard)
        factor = np.where(y, 1 / np.expm1(np.clip(hazard, 1e-6, 500)), -1.0)
        # a label may be wrong now and then: no document pulls by more than so much
        g = np.clip(s * factor[bag], -1, 1)
        grad = np.append(np.bincount(column, weights=g[sentence], minlength=len(chosen)) - ridge * (w - first), g.sum()) / len(y)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w, b = w + step[:-1], b + step[-1]
    weights = np.zeros(size)
    weights[chosen] = w
    return Model(weights, float(b), order)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> Model:
    """The model of a bounded sample of the labelled rows that aren't held out.

    Labels that are null, of a null id or of no document are left out; of a
    repeated id in ``labels`` the largest label counts. Null and empty texts
    are bags without sentences. Other columns of either table are not read.
    """
    return fit(features(sample(docs, labels, label, id_col, text_col, bound), _per_row))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cutoff: float = 0.5) -> DataFrame:
    """One row per input row: ``id_col, held_out, score, predicted, sentences``.

    ``sentences`` lists start, end (code points) and probability of those
    sentences at or over ``cutoff``. One pass, no shuffle; the model (2**BITS
    weights and as many ranks, 8 MB) goes out as a broadcast variable. Null and empty texts have
    no sentence and score 0; null ids and repeated rows are scored as they
    come. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.order.astype(np.float32)))
    place = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Model(*sent.value)
        for batch in batches:
            scores, found = [np.zeros(0)], []
            for s in slices(batch.column(2)):
                row, start, end, p = here.sentences(s)
                scores.append(noisy_or(row, p, s.rows))
                lists: list[list] = [[] for _ in range(s.rows)]
                bad = np.flatnonzero(p >= cutoff)
                if len(bad):
                    points = np.zeros(len(s.data) + 1, np.int32)
                    np.cumsum((s.data & 0xC0) != 0x80, dtype=np.int32, out=points[1:])
                    for k in bad:
                        base = points[s.offsets[row[k]]]
                        lists[row[k]].append({"start": int(points[start[k]] - base), "end": int(points[end[k]] - base), "p": float(p[k])})
                found += lists
            p = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= cutoff).astype(np.int32)), pa.array(found, pa.list_(place))], ["id", "held_out", "score", "predicted", "sentences"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    schema = "id bigint, held_out boolean, score double, predicted int, sentences array<struct<start:bigint,end:bigint,p:double>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
