"""Hard negatives and centroid clusters against brute force with Python's integers; odd rows, ties, large components."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessellar.llm import centroids, negatives

NAN, INF = float("nan"), float("inf")


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 9), st.integers(0, 12), st.sampled_from([3, 2**12, 2**20, 2**31, 2**45, 2**80]), st.randoms(use_true_random=False))
def test_packed_products_are_exact(dims, count, size, rng):
    x = [[rng.randint(-size, size) for _ in range(dims)] for _ in range(count)]
    a = [rng.randint(-size, size) for _ in range(dims)]
    kind = np.int64 if size <= 2**40 else object
    got = negatives.Packed(np.array(x, kind).reshape(count, dims)).scores(np.array(a, kind))
    assert [int(s) for s in got] == [sum(u * v for u, v in zip(r, a, strict=True)) for r in x]


def test_integers_at_any_size():
    values = [np.array([0.3, -0.3, 1e30, -1e300, 2.0**53 + 2, -7.00390625])]
    assert negatives.integers(values, 256, 7)[0].tolist() == [math.floor(256 * 0.3), math.floor(256 * -0.3), int(1e30) * 256, int(-1e300) * 256, (2**53 + 2) * 256, -1793, 0]


def _mined(rows, positives=5, most=10):
    """All scores of every anchor in turn."""
    rows = [(k, v, y) for k, v, y in rows if v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    q = [[math.floor(256 * x) for x in v] for _, v, _ in rows]
    order = lambda k: (k is None, k or 0)
    out = []
    for a, (key, _, label) in enumerate(rows):
        if key is None or key % 100:
            continue
        s = [sum(u * v for u, v in zip(q[a], x, strict=False)) for x in q]
        same = sorted((b for b in range(len(rows)) if b != a and rows[b][2] == label), key=lambda b: (-s[b], order(rows[b][0])))
        other = sorted((b for b in range(len(rows)) if rows[b][2] != label), key=lambda b: (-s[b], order(rows[b][0])))
        for p in same[:positives]:
            band = [b for b in other if 30 * s[p] <= 100 * s[b] <= 90 * s[p]][:most]
            out += [(key, rows[p][0], n + 1, rows[b][0], s[p], s[b]) for n, b in enumerate(band)]
    return sorted(out, key=str)


def _run(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumns({k: F.lit(7) for k in ("id", "row", "vector", "known", "g", "h", "score", "place", "rank")})
    got = negatives.mine(negatives.usable(df), **how)
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    return sorted((tuple(r) for r in got.collect()), key=str)


def _vectors(n, dims=6, seed=1, spread=1.0):
    rng = random.Random(seed)
    return [(k, [rng.gauss(0.4, spread) for _ in range(dims)], rng.choice([0, 0, 0, 1, 2])) for k in range(n)]


def test_negatives(spark):
    rows = _vectors(450)
    # ties, repeated rows and anchors, null and odd ones
    rows += [(k + 1000, rows[k][1], (rows[k][2] + 1) % 3) for k in range(60)] + rows[:3] + rows[100:101] + [(200, rows[7][1], rows[7][2])]
    rows += [(300, None, 1), (400, [0.1, None, 0.2], 1), (500, [0.1, NAN], 1), (600, [INF, 1.0], 1), (700, rows[1][1], None), (None, rows[2][1], 1), (None, rows[3][1], 0), (800, [], 1), (900, [0.5, 0.5], 0), (-100, rows[4][1], -3)]
    want = _mined(rows)
    assert len(want) > 100
    assert _run(spark, rows) == want
    # the plan by blocks, and one label for nearly all rows
    assert _run(spark, rows, shard=70, group=3) == want
    hot = [(k, v, 0 if k % 9 else y) for k, v, y in rows if k is not None]
    assert _run(spark, hot, shard=100, group=2) == _mined(hot)


def test_negatives_of_large_components_and_none(spark):
    rows = [(k, [x * 1e4 for x in v], y) for k, v, y in _vectors(210)]
    assert _run(spark, rows) == _mined(rows)
    huge = [(k, [x * 1e12 for x in v], y) for k, v, y in _vectors(110)]
    assert [r[:4] for r in _run(spark, huge)] == [r[:4] for r in _mined(huge)] and all(r[4] is None for r in _run(spark, huge))
    assert _run(spark, []) == [] == _run(spark, [(1, [0.5], 1), (2, [0.5], 1)])


def _clustered(rows, count=8, rounds=10):
    kept = [(k, tuple(math.floor(1024 * x) for x in v)) for k, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda k: hashlib.sha256(f"3:{k}".encode()).hexdigest()
    begin = sorted(kept, key=lambda r: (r[0] is None, digest(r[0]), centroids.transform(np.array(r[1])).tolist()))
    places = [list(v) for _, v in begin[:count]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in places]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        where = assign()
        for c in range(len(places)):
            own = [v for (k, _), (_, v) in zip(where, kept, strict=True) if k == c]
            if own:
                places[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    where = assign()
    total = sum(d for _, d in where)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in places]
    return sorted([(key, c, d, sum(e for b, e in where if b == c), total, sha[c]) for (key, _), (c, d) in zip(kept, where, strict=True)], key=str)


def _cluster(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({k: F.lit(7) for k in ("id", "x", "cluster", "distance", "k", "n")})
    return sorted((tuple(r) for r in centroids.cluster(df, **how).collect()), key=str)


def _places(n, seed=2, size=1.0):
    rng = random.Random(seed)
    return [(k, [rng.gauss((k % 5) * 0.4, 0.5) * size for _ in range(64)]) for k in range(n)]


def test_clusters(spark):
    rows = _places(260)
    rows += rows[:9] + [(k + 500, rows[k][1]) for k in range(20)] + [(7, rows[30][1]), (None, rows[1][1]), (900, None), (901, [0.1] * 63), (902, [0.1] * 63 + [None]), (903, [NAN] + [0.1] * 63), (904, [INF] * 64), (905, [])]
    assert _cluster(spark, rows) == _clustered(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], _places(1), _places(3), [(k, [0.25] * 64) for k in range(30)], [(k, [float(k % 2)] * 64) for k in range(40)], _places(60, size=3e4)])
def test_small_even_and_large_clusters(spark, rows):
    assert _cluster(spark, rows) == _clustered(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([1, 2, 50, 2**20, 2**40]), st.integers(1, 9))
def test_search_is_exact(seed, size, count):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-size, size + 1, (30, 64)), rng.integers(-size, size + 1, (count, 64))
    best, distance = centroids.nearest(centroids.transform(x), centroids.transform(c))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v, strict=True)) for v in c] for u in x]
    assert best.tolist() == [d.index(min(d)) for d in want] and [int(d) for d in distance] == [min(d) for d in want]
    assert centroids.restored(centroids.transform(x[0])).tolist() == x[0].tolist()
