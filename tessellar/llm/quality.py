"""Quality classifier: Naive Bayes features in a linear support vector machine.

Features are indicators of n-grams, of one and two words (A-Z lower-cased) and
of one to three word shapes: upper and lower case letters, digits and other
signs of a word with repeats run together, and a sign of its own for a word
that repeats the one before. Each is scaled by the log ratio of its smoothed
frequencies in the two classes; a linear model with hinge loss is fitted by
dual coordinate descent, and its margin is turned to a probability by a
logistic fit.
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
from .words import LOWER, SHAPE, Slice, hash_spans, mix, slices, stream, words

BITS = 20  #: of a feature's number
GRAMS = 3
WORDS = 2
_SAME = stream(11, 1)[0]
_COEF = stream(12, GRAMS) | np.uint64(1)
_SIZE = stream(13, GRAMS)
_WORD = stream(14, WORDS)


def _grams(h: np.ndarray, row: np.ndarray, start: np.ndarray) -> Iterator[np.ndarray]:
    """Row and feature, as one number, of every run of one, two, ... words of a row; ``start`` has a number for each length."""
    for n in range(1, len(start) + 1):
        size = len(h) - n + 1
        if size <= 0:
            return
        value = np.zeros(size, np.uint64) + start[n - 1]
        for k in range(n):
            value += h[k : k + size] * _COEF[k]
        same = row[n - 1 :] == row[:size]
        yield (row[:size][same].astype(np.uint32) << np.uint32(BITS)) | (mix(value[same]) >> np.uint64(64 - BITS)).astype(np.uint32)


def grams(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Of a slice the distinct (row, feature) pairs, sorted, as two arrays."""
    w = words(s)
    if not len(w.start):
        return w.row, w.row
    code = SHAPE[s.data]
    keep = np.ones(len(code), bool)
    keep[1:] = code[1:] != code[:-1]
    keep[w.start] = True
    at = np.zeros(len(code) + 1, np.int32)
    np.cumsum(keep, dtype=np.int32, out=at[1:])
    shape = hash_spans(code[keep], at[w.start], at[w.end])
    whole = hash_spans(s.data, w.start, w.end)
    shape[1:][(whole[1:] == whole[:-1]) & (w.row[1:] == w.row[:-1])] = _SAME
    word = hash_spans(LOWER[s.data], w.start, w.end)
    key = np.unique(np.concatenate([*_grams(shape, w.row, _SIZE), *_grams(word, w.row, _WORD)]))
    return (key >> np.uint32(BITS)).astype(np.int64), key & np.uint32((1 << BITS) - 1)


def _per_row(column: pa.Array) -> Iterator[np.ndarray]:
    for s in slices(column):
        row, feature = grams(s)
        yield from np.split(feature, np.searchsorted(row, np.arange(1, s.rows)))


class Rows:
    """Positions and values of each row, of which only the positions that count are kept: the values are made when a row is read."""

    def __init__(self, rows: list[np.ndarray], ratio: np.ndarray):
        self.ratio = ratio
        self.at = [np.append(f[ratio[f] != 0], np.int32(len(ratio))) for f in rows]
        self.norm = [max(float(np.sqrt(v @ v)), 1.0) for v in (ratio[at[:-1]] for at in self.at)]

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.at[k]
        return at, np.append(self.ratio[at[:-1]] / self.norm[k], 1.0)


def dual_descent(x: Rows, y: np.ndarray, size: int, cost: np.ndarray, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Weights of the L2-regularised SVM with (linear) hinge loss. x: positions and values of each row; y: -1 or 1.

    Of the dual one coordinate at a time is minimised, between 0 and the row's cost.
    """
    w = np.zeros(size)
    alpha = np.zeros(len(x))
    square = np.array([float(v @ v) for _, v in x])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for k in order.permutation(len(x)):
            at, value = x[k]
            gradient = y[k] * float(w[at] @ value) - 1
            new = min(max(alpha[k] - gradient / square[k], 0.0), cost[k])
            if new != alpha[k]:
                w[at] += (new - alpha[k]) * y[k] * value
                alpha[k] = new
    return w


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of P(1 | margin), by Newton steps, targets smoothed by class sizes."""
    up, down = int((y > 0).sum()), int((y <= 0).sum())
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, np.log((up + 1) / (down + 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        g, v = p - target, np.maximum(p * (1 - p), 1e-9)
        ga, gb = float(g @ margin) + 1e-3 * a, float(g.sum())
        haa, hab, hbb = float(v @ margin**2) + 1e-3, float(v @ margin), float(v.sum()) + 1e-9
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - step * da, b - step * db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, s: Slice) -> np.ndarray:
        row, feature = grams(s)
        z = np.bincount(row, weights=self.weights[feature], minlength=s.rows) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(rows: list[tuple[int, np.ndarray]], least: int = 3, alpha: float = 1.0, cost: float = 1.0) -> Model:
    """From labels and features of each row. With one class only (or none) the score is that class's (or one half)."""
    y = np.array([1 if label else -1 for label, _ in rows])
    if not len(y) or abs(y.sum()) == len(y):
        return Model(np.zeros(1 << BITS), 0.0 if not len(y) else 4.0 * y[0])
    size = 1 << BITS
    p, q = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for label, f in rows:  # a row's features are distinct
        (p if label else q)[f] += 1
    ratio = np.log((p + alpha) / (p + alpha).sum()) - np.log((q + alpha) / (q + alpha).sum())
    ratio[p + q < least] = 0
    x = Rows([f for _, f in rows], ratio)
    per = {c: len(y) / (2 * (y == c).sum()) for c in (-1, 1)}
    w = dual_descent(x, y, size + 1, np.array([cost * per[c] for c in y]))
    return _calibrated(w, ratio, rows, y, size)


def _calibrated(w: np.ndarray, ratio: np.ndarray, rows: list[tuple[int, np.ndarray]], y: np.ndarray, size: int) -> Model:
    weights = w[:size] * ratio
    margin = np.array([float(weights[f].sum()) for _, f in rows]) + w[size]
    # in units of their spread: Newton steps from slope 1 go astray on margins of hundreds
    scale = float(margin.std()) or 1.0
    a, b = logistic(margin / scale, y)
    a /= scale
    return Model(weights * a, float(w[size] * a + b))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> Model:
    """The model of a bounded sample of the labelled rows that aren't held out.

    Labels that are null, of a null id or of no document are left out; of a
    repeated id in ``labels`` the largest label counts. Null and empty texts
    have no features. Other columns of either table are not read.
    """
    return fit(features(sample(docs, labels, label, id_col, text_col, bound), _per_row))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cutoff: float = 0.3) -> DataFrame:
    """One row per input row: ``id_col, held_out, score, predicted``.

    One pass, no shuffle; the model (2**BITS weights, 4 MB) goes out as a
    broadcast variable. Null and empty texts have no features and get the
    score of the intercept; null ids and repeated rows are scored as they
    come. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Model(*sent.value)
        for batch in batches:
            p = np.concatenate([here.score(s) for s in slices(batch.column(2))] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= cutoff).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutoff: float = 0.3) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; nothing is shuffled."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    @F.arrow_udf("double")
    def quality(text: pa.Array) -> pa.Array:
        here = Model(*sent.value)
        return pa.array(np.concatenate([here.score(s) for s in slices(text)] or [np.zeros(0)]), pa.float64())

    return docs.where(quality(F.col(text_col)) >= cutoff)
