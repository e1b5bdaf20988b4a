"""Clusters of integer vectors around centroids, searched through Walsh-Hadamard coefficients.

Vectors and centroids are transformed once, exactly and in integers; squared
distances are those of the coefficients over their number. A vector's search
accumulates squared differences from the coarse coefficients (few sign changes)
to the fine ones. The centroid that leads after the first few is finished, and
whatever is strictly beyond it by a part of its coefficients goes; the others are
finished with all of them, so that the nearest, and of equally near ones the
first, is exact.

The transform is linear: a centroid's new place follows from its vectors' summed
coefficients. A round is one pass over the stored coefficients; the driver sees
a count and a sum of coefficients for each centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from .store import cut

DIMS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Coefficients after which beaten centroids go.
STAGES = (4, 12, 28, 64)
#: Coefficients below it are differenced and squared in 64 bits, others as Python's integers; those from MOST on aren't taken.
SMALL, MOST = 2**27, 2**62


def _changes(k: int) -> int:
    """Sign changes along a row of the Hadamard matrix."""
    signs = [(k & t).bit_count() & 1 for t in range(DIMS)]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


#: Rows of the Hadamard matrix from coarse to fine.
ORDER = np.array(sorted(range(DIMS), key=_changes))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast transform along the last axis, in natural order; done twice it is DIMS times the identity."""
    step = 1
    while step < DIMS:
        y = x.reshape(*x.shape[:-1], DIMS // (2 * step), 2, step)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        step *= 2
    return x


def transform(x: np.ndarray) -> np.ndarray:
    """Coefficients of integer vectors, coarse to fine."""
    return _hadamard(x)[..., ORDER]


def restored(coefficients: np.ndarray) -> np.ndarray:
    """The vector (of Python's integers) with these coefficients."""
    natural = np.empty(DIMS, object)
    natural[ORDER] = [int(c) for c in coefficients]
    return _hadamard(natural) // DIMS


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of coefficients the number of the nearest centroid, the smaller of equally near ones, and the squared distance."""
    size = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.int64 if size < SMALL else object
    x, centroids = x.astype(kind), centroids.astype(kind)
    n = len(x)
    sums = np.zeros((n, len(centroids)), kind)
    rows, cols = (k.ravel() for k in np.indices(sums.shape))
    limit, done = None, 0
    for upto in STAGES:
        part = x[rows, done:upto] - centroids[cols, done:upto]
        sums[rows, cols] += (part * part).sum(axis=1)
        done = upto
        if limit is None:
            leader = sums.argmin(axis=1) if n else np.zeros(0, np.int64)
            part = x - centroids[leader]
            limit = (part * part).sum(axis=1)
        near = sums[rows, cols] <= limit[rows]
        rows, cols = rows[near], cols[near]
    # what is left has all coefficients; the leader is among it
    far = np.ones(sums.shape, bool)
    far[rows, cols] = False
    sums[far] = limit.max() + 1 if n else 0
    best = sums.argmin(axis=1) if n else np.zeros(0, np.int64)
    return best, sums[np.arange(n), best] // DIMS


def _coefficients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, DIMS)
        whole = np.floor(SCALE * values)
        if np.abs(whole).max(initial=0) >= MOST // DIMS:
            raise ValueError(f"a component times {SCALE} isn't under {MOST // DIMS}")
        flat = transform(whole.astype(np.int64)).ravel()
        offsets = pa.array(np.arange(0, len(flat) + 1, DIMS), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)


def _summing(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [0] * len(centroids)
        sums = np.zeros((len(centroids), DIMS), object)
        for batch in batches:
            x = _matrix(batch.column(1))
            best, _ = nearest(x, centroids)
            for k in np.unique(best):
                own = x[best == k]
                counts[k] += len(own)
                sums[k] += (own if np.abs(own).max() < 2**40 else own.astype(object)).sum(axis=0).astype(object)
        some = [k for k, n in enumerate(counts) if n]
        text = [[str(v) for v in sums[k]] for k in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([counts[k] for k in some], pa.int64()), pa.array(text, pa.list_(pa.string()))], ["cluster", "n", "sums"])

    return run


def _assigning(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, distance = nearest(_matrix(batch.column(1)), centroids)
            # a distance that no long holds is null
            held = pa.array([int(d) if d < 2**63 else None for d in distance], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), held], ["vec_id", "cluster", "distance"])

    return run


def _moved(x: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round; those without vectors stay."""
    partial = x.mapInArrow(_summing(centroids), "cluster int, n bigint, sums array<string>")
    wide = partial.select("cluster", "n", F.posexplode("sums").alias("k", "s"))
    rows = wide.groupBy("cluster", "k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # CENTROIDS * DIMS at most
    out = centroids.copy()
    for cluster in {r.cluster for r in rows}:
        own = sorted((r.k, int(r.s), r.n) for r in rows if r.cluster == cluster)
        mean = restored(np.array([s for _, s, _ in own], object)) // own[0][2]
        out[cluster] = transform(mean)
    return out


def cluster(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part.

    Vectors of another length than 64 and those with a null or non-finite
    component are left out. Repeated rows count as often as they stand. Of
    equal ids the vector with the lesser coefficients is the first to begin a
    centroid; a row with a null id is a vector but begins one only where no
    others are left. With fewer vectors than ``centroids`` there are as many
    centroids as vectors. Components may be up to 2^46; distances and sums that
    no long holds are null. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    ship(spark)
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = own.where(F.col("x").isNotNull() & (F.size("x") == DIMS) & ~bad)
    x = cut(kept.mapInArrow(_coefficients, "id bigint, x array<bigint>"), "centroids-vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = x.orderBy(F.asc_nulls_last(key), "x").limit(centroids).select("x").collect()  # so few rows
    places = np.array([r.x for r in first], object).reshape(-1, DIMS)
    for _ in range(rounds if len(places) else 0):
        places = _moved(x, places)
    if not len(places):
        return x.select(F.col("id").alias("vec_id"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    assigned = cut(x.mapInArrow(_assigning(places), "vec_id bigint, cluster int, distance bigint"), "centroids-assigned")
    whole = F.col("distance").cast("decimal(38,0)")
    sums = assigned.groupBy("cluster").agg(F.sum(whole).alias("own"), F.count(F.when(F.col("distance").isNull(), 1)).alias("lost")).collect()  # a row a centroid
    exact = {r.cluster: int(r.own) if not r.lost and r.own < 2**63 else None for r in sums}
    total = None if None in exact.values() or sum(exact.values()) >= 2**63 else sum(exact.values())
    sha = [hashlib.sha256(",".join(str(v) for v in restored(p)).encode()).hexdigest() for p in places]
    facts = [(k, exact[k], total, sha[k]) for k in sorted(exact)]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
