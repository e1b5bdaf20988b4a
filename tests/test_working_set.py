"""Problems leave the iteration as they settle; snapshots survive a writer that is lost; roots' changes against differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.operators import adjoint, cells, ising, variational
from tessellar.operators.tensor import Tensor

from .test_networks import found, packed
from .test_tensors import some


def test_settled_problems_leave(spark, monkeypatch):
    betas = spark.createDataFrame([(0.2,), (0.45,)], "beta double")  # far from the critical point, and near it
    t = ising.bulk(betas, "dgeb")
    df = t.df.select(*t.index, F.round(F.col("beta") * 100).cast("long").alias("problem"), F.lit(0).alias("i"), F.lit(0).alias("j"), "re", "im")
    bulk = Tensor(df, t.index, t.dims, cells.KEYS)
    begin = variational.start(bulk, 3, 1, 1)
    sizes, real = [], variational.step

    def counted(state, rows, columns):
        sizes.append(state.select("problem").distinct().count())
        return real(state, rows, columns)

    monkeypatch.setattr(variational, "step", counted)
    state, error = variational.solve(begin, 1, 1, tol=1e-6, maxiter=6)
    assert sizes[0] == 2 and sizes[-1] == 1
    assert sorted(r.problem for r in state.select("problem").distinct().collect()) == [20, 45]
    counts = {r.problem: r["count"] for r in state.groupBy("problem").count().collect()}
    assert counts[20] == counts[45] == 6
    z = {r.problem: r.z for r in variational.partition_per_site(state, bulk, 3, 1, 1).collect()}
    whole, errors = variational.solve_whole(begin, 1, 1, tol=1e-6, maxiter=6)
    for r in variational.partition_per_site(whole, bulk, 3, 1, 1).collect():
        assert z[r.problem] == pytest.approx(r.z, rel=1e-7)
    assert error == pytest.approx(max(r.error for r in errors.collect()), rel=0.1, abs=1e-6)


def test_snapshots_are_committed_last(spark, tmp_path):
    state = lambda k: packed(spark, ("C", np.full((2, 2, 1, 1), float(k))))
    at = str(tmp_path)
    value = lambda: variational.load(spark, at, "up", 2, 3).first().re[0]
    for k in (1, 2, 3):
        variational.save(state(k), at, "up", 2, 3)
        assert value() == k
    # a writer that is lost before its commit leaves a table that isn't read
    state(9).write.parquet(f"{at}/direction=up/D=3/chi=2/version-4")
    assert value() == 3
    # the next one writes over it
    variational.save(state(4), at, "up", 2, 3)
    assert value() == 4 and spark.read.parquet(f"{at}/direction=up/D=3/chi=2/version-2").count() == 0
    # a state that is saved over the one it was read from
    variational.save(variational.load(spark, at, "up", 2, 3), at, "up", 2, 3)
    assert value() == 4


def test_changes_of_roots(spark):
    x, d, g = some(1, 3, 3), some(2, 3, 3), some(3, 3, 3)
    a, d, g = x @ x.conj().T, d + d.conj().T, g + g.conj().T
    t = found(adjoint.matrix_roots(packed(spark, *((k, v[..., None, None]) for k, v in (("A", a), ("DA", d), ("GS", g))))))
    assert np.allclose(t["S", 0, 0] @ t["S", 0, 0], a)

    def root(m):
        values, vectors = np.linalg.eigh(m)
        return (vectors * np.sqrt(values)) @ vectors.conj().T

    h = 1e-5
    change = (root(a + h * d) - root(a - h * d)) / (2 * h)
    assert np.allclose(t["DS", 0, 0], change, atol=1e-7)
    assert np.vdot(t["GA", 0, 0], d).real == pytest.approx(np.vdot(g, change).real, rel=1e-6)
