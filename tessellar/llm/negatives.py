"""Hard negatives by exact integer products, several candidates to a multiplication.

Components are integers. Those of a block of candidates are biased to be 0 or
more and laid side by side as fields of one wide integer for each dimension
(Kronecker's substitution); an anchor's components, biased too, multiply one such
integer each, and the sum of the products holds the inner products of all
candidates in its fields, which are wide enough for the largest. Taking the
biases' share off gives exact scores.

Anchors and candidates meet in blocks: a group of anchors with a shard of all
rows. A first pass finds each anchor's positives, a second, which knows their
scores, the negatives in each positive's band; of every block only the first few
of each leave the task.
"""

from __future__ import annotations

import math
from decimal import Decimal
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ship import ship
from .store import cut

#: Rows of a shard of candidates and anchors of a group; a small table is dealt to some more tasks.
SHARD, GROUP, TASKS, LEAST = 65536, 1024, 12, 4096
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 30, 90


def integers(vectors: list[np.ndarray], scale: int, dims: int) -> np.ndarray:
    """floor(scale * x) as a matrix, a short vector filled up with zeros; Python's integers where 64 bits wouldn't do."""
    out = np.zeros((len(vectors), dims))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    if not out.size or np.abs(out).max() < 2**40:
        return np.floor(scale * out).astype(np.int64)
    # doubles from 2^53 on are integers
    exact = [int(x) * scale if abs(x) >= 2**53 else math.floor(scale * x) for x in out.ravel().tolist()]
    return np.array(exact, object).reshape(out.shape)


class Packed:
    """The components of a block of candidates as wide integers, one for each dimension."""

    def __init__(self, candidates: np.ndarray):
        self.count = len(candidates)
        self.least = int(candidates.min(initial=0))
        self.sums = candidates.sum(axis=1)
        self.biased = candidates - self.least
        self.most = [int(x) for x in self.biased.max(axis=0, initial=0)]
        self.size = max(map(abs, (self.least, *(x + self.least for x in self.most))))
        self.wide: dict[int, list[int]] = {}

    def _fields(self, width: int) -> list[int]:
        """Fields of ``width`` bytes, the first candidate in the lowest."""
        got = self.wide.get(width)
        if got is None:
            if width in (4, 8) and self.biased.dtype != object:
                columns = self.biased.T.astype(f"<u{width}")
                got = [int.from_bytes(c.tobytes(), "little") for c in columns]
            else:
                got = [int.from_bytes(b"".join(int(x).to_bytes(width, "little") for x in c), "little") for c in self.biased.T]
            self.wide[width] = got
        return got

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """The inner product of every candidate with ``anchor``."""
        bias = min(0, *(int(x) for x in anchor)) if len(anchor) else 0
        parts = [int(x) - bias for x in anchor]
        # a field holds the sum, and each component, also one that is multiplied by 0
        bits = max(sum(map(mul, self.most, parts)), *self.most, 0).bit_length()
        width = 4 if bits <= 32 else 8 if bits <= 63 else bits // 8 + 1
        total = sum(f * a for f, a in zip(self._fields(width), parts, strict=True) if a)
        raw = total.to_bytes(width * self.count, "little")
        whole = sum(parts) + bias * len(parts)
        rest = self.least * whole - len(parts) * self.least * bias
        # every term of what follows is under 2^62 in that case
        if width <= 8 and self.sums.dtype != object and len(parts) * self.size * (abs(bias) + max(parts, default=0)) < 2**60:
            return np.frombuffer(raw, f"<u{width}").astype(np.int64) + bias * self.sums + rest
        fields = [int.from_bytes(raw[k : k + width], "little") for k in range(0, len(raw), width)]
        return np.array([f + bias * int(s) + rest for f, s in zip(fields, self.sums, strict=True)], object)


def _first(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the highest scores, the earlier of equal ones first."""
    if len(scores) > 4 * most and scores.dtype != object:
        border = np.partition(scores, len(scores) - most)[len(scores) - most]
        at = np.flatnonzero(scores >= border)
        return at[np.argsort(-scores[at], kind="stable")[:most]]
    return np.argsort(-scores, kind="stable")[:most]


def _blocks(anchors: pd.DataFrame, candidates: pd.DataFrame, scale: int):
    """Of a block the candidates in order of ids (null ones last), and of each anchor its scores."""
    candidates = candidates.rename(columns=lambda k: k.removeprefix("c_")).sort_values(["known", "id"], ascending=[False, True], kind="stable", ignore_index=True)
    dims = max(len(v) for side in (anchors, candidates) for v in side["vector"])
    packed = Packed(integers(list(candidates["vector"]), scale, dims))
    own = integers(list(anchors["vector"]), scale, dims)
    return candidates, (packed.scores(a) for a in own)


#: Scores are handed on as decimals of as many digits as Spark has; those of a result are longs, null where one doesn't do.
_FOUND = "anchor bigint, anchor_id bigint, place int, positive_id bigint, positive_score decimal(38,0), id bigint, known boolean, score decimal(38,0)"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _FOUND.split(", ")])


def _positives(scale: int, most: int):
    def run(anchors: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(candidates):
            candidates, scores = _blocks(anchors, candidates, scale)
            rows, ids, known = (candidates[k].to_numpy() for k in ("row", "id", "known"))
            same = candidates.groupby("label").indices
            for row, anchor, label, s in zip(anchors["row"], anchors["id"], anchors["label"], scores, strict=True):
                at = np.asarray(same.get(label, ()), np.int64)
                at = np.sort(at[rows[at] != row])
                for k in at[_first(s[at], most)]:
                    out.append((row, anchor, 0, None, None, ids[k], bool(known[k]), Decimal(int(s[k]))))
        return _frame(out)

    return run


def _negatives(scale: int, most: int, low: int, high: int):
    def run(anchors: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(candidates):
            candidates, scores = _blocks(anchors, candidates, scale)
            ids, known, labels = (candidates[k].to_numpy() for k in ("id", "known", "label"))
            for row, anchor, label, positives, s in zip(anchors["row"], anchors["id"], anchors["label"], anchors["positives"], scores, strict=True):
                bands = []
                for p in positives:
                    score = int(p["positive_score"])
                    bands.append((-(-low * score // 100), high * score // 100, p))
                lows, highs = [a for a, b, _ in bands if a <= b], [b for a, b, _ in bands if a <= b]
                if not lows:
                    continue
                at = np.flatnonzero((s >= min(lows)) & (s <= max(highs)) & (labels != label))
                at = at[np.argsort(-s[at], kind="stable")]
                falling = -s[at]
                for a, b, p in bands:
                    begin = int(np.searchsorted(falling, -b, "left"))
                    end = int(np.searchsorted(falling, -a, "right"))
                    for k in at[begin : min(end, begin + most)]:
                        out.append((row, anchor, p["place"], p["positive_id"], p["positive_score"], ids[k], bool(known[k]), Decimal(int(s[k]))))
        return _frame(out)

    return run


def _ranked(found: DataFrame, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("known"), "id")
    return found.withColumn("rank", F.row_number().over(order))


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id, vector, label`` of the rows whose label and vector are there and whose components are all finite."""
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).cast("long").alias("label"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return own.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad)


def mine(rows: DataFrame, anchors: str = "id % 100 = 0", scale: int = 256, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``rows`` (see ``usable``).

    ``anchors`` is an SQL condition on ``id``; a row with a null id is never an
    anchor, and as a candidate it comes last of equal scores. Repeated rows
    and ids are rows of their own: each is an anchor, and a copy of an anchor is
    a positive of it. A vector shorter than another counts as filled up with
    zeros. A positive with a negative score has no negatives. Scores are exact
    at any size of components; one that no long holds is null in the result. An
    empty table gives an empty result.

    Every anchor meets every row: shards of ``shard`` rows with groups of
    ``group`` anchors, whatever the labels, so that a label with most of the
    rows makes no large task.
    """
    ship(rows.sparkSession)
    own = rows.select(F.monotonically_increasing_id().alias("row"), F.coalesce("id", F.lit(2**63 - 1)).alias("id"), F.col("id").isNotNull().alias("known"), "label", "vector")
    own = cut(own, "negatives-rows")
    count = own.count()
    chosen = own.where(F.col("known") & F.expr(anchors)).drop("known")
    shards = max(-(-count // shard), min(TASKS, -(-count // LEAST)), 1)
    groups = max(-(-chosen.count() // group), 1)
    number = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = 4 * shards * groups
    # under columns of its own, as both sides of the meeting come from one table
    candidates = own.select(*(F.col(k).alias(f"c_{k}") for k in own.columns), number(shards).alias("c_h")).withColumn("c_g", every(groups)).repartition(spread, "c_g", "c_h")

    def meet(side: DataFrame, run) -> DataFrame:
        dealt = side.withColumns({"g": number(groups), "h": every(shards)}).repartition(spread, "g", "h")
        return dealt.groupBy("g", "h").cogroup(candidates.groupBy("c_g", "c_h")).applyInPandas(run, _FOUND)

    first = _ranked(meet(chosen, _positives(scale, positives)), "anchor").where(F.col("rank") <= positives)
    best = first.select(F.col("anchor").alias("row"), F.struct(F.col("rank").alias("place"), F.when(F.col("known"), F.col("id")).alias("positive_id"), F.col("score").alias("positive_score")).alias("p"))
    # at most ``positives`` of an anchor
    best = best.groupBy("row").agg(F.collect_list("p").alias("positives"))
    second = meet(chosen.join(cut(best, "negatives-positives"), "row"), _negatives(scale, negatives, low, high))
    last = _ranked(second, "anchor", "place").where(F.col("rank") <= negatives)
    long = lambda name: F.expr(f"try_cast({name} AS bigint)")
    return last.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("known"), F.col("id")).alias("negative_id"), long("positive_score").alias("positive_score"), long("score").alias("negative_score"))
