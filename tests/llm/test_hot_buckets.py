"""Near duplicates where many documents share a passage: no link of a large bucket is lost."""

import numpy as np
import pyarrow as pa

from tessellar.llm import neardup
from tessellar.llm.words import slices


def test_split_buckets_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    g = np.random.default_rng(1)
    shared = [f"p{k}" for k in range(150)]
    rows = []
    for d in range(120):
        own = [f"o{d // 3}x{k}" for k in range(60)]
        own[int(g.integers(0, 60))] = f"y{d}"
        rows.append((d, " ".join(shared + own)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=85).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    least = list(range(120))
    for _ in range(5):
        for a in range(120):
            for b in range(120):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    assert got == dict(enumerate(least)) and len(set(least)) == 40


def test_pairs_that_meet_only_in_a_large_bucket(spark, monkeypatch):
    """Classes that share one bucket and no other are compared however large it is."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    shared = [f"p{k}" for k in range(150)]
    rows = []
    for d in range(240):
        pair = [f"q{d // 2}x{k}" for k in range(30)]
        rows.append((d, " ".join(shared + pair + [f"o{d}x{k}" for k in range(50)])))
    values, starts = neardup.sets(next(slices(pa.array([t for _, t in rows]))))
    r = neardup.registers(values, starts).reshape(240, neardup.BANDS, neardup.ROWS)
    meet = (r[:, None] == r[None]).all(axis=3)
    size = meet.sum(axis=1)
    sets = [set(values[a:b].tolist()) for a, b in zip(starts[:-1], starts[1:])]
    least, only = list(range(240)), 0
    for a in range(0, 240, 2):
        bands = meet[a, a + 1]
        assert 100 * len(sets[a] & sets[a + 1]) >= 60 * len(sets[a] | sets[a + 1]) and 100 * len(sets[a] & sets[a - 1]) < 60 * len(sets[a] | sets[a - 1])
        if bands.any():
            least[a + 1] = a
        only += bands.sum() == 1 and size[a][bands][0] > neardup.BLOCK
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=60).collect()}
    assert only and got == dict(enumerate(least))
