"""What fitting holds on the driver, and the order of rows that were fetched."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tessellar.llm import quality, training


def test_fit_holds_little_more_than_the_features(monkeypatch):
    monkeypatch.setattr(quality, "BITS", 14)
    g = np.random.default_rng(3)
    rows = [(k % 2, np.flatnonzero(g.random(1 << 14) < (0.2, 0.21)[k % 2]).astype("<i4")) for k in range(300)]
    tracemalloc.start()
    quality.fit(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * sum(f.nbytes for _, f in rows)


def test_order_and_ties():
    of = lambda *x: np.array(x, "<i4")
    rows = [(1, 5, of(7, 8)), (0, 5, of()), (1, -2, of(3)), (1, 5, of(7, 2)), (0, 9, of(1))]
    table = pa.table({"label": pa.array([r[0] for r in rows], pa.int32()), "place": pa.array([r[1] for r in rows], pa.int64()), "features": pa.chunked_array([[r[2].tobytes() for r in rows[:2]], [r[2].tobytes() for r in rows[2:]]], pa.binary())})
    assert [(label, f.tolist()) for label, f in training.in_order(table)] == [(1, [3]), (0, []), (1, [7, 2]), (1, [7, 8]), (0, [1])]
