import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.functions import dense
from tessellar.operators import cells, environments, ising, variational
from tessellar.operators.contract import contract
from tessellar.operators.tensor import Tensor

from .test_tensors import some


def packed(spark, *named):
    """One problem's tensors: (name, array with the cell's row and column last)."""
    rows = []
    for name, x in named:
        for i, j in np.ndindex(*x.shape[-2:]):
            cell = x[..., i, j]
            rows.append((0, name, i, j, list(cell.shape), cell.real.ravel().tolist(), cell.imag.ravel().tolist()))
    return spark.createDataFrame(rows, cells.SCHEMA)


def found(df):
    return {k: x for k, x in cells.read(df.toPandas()).items()}


def test_leading_takes_the_largest_real_part_of_one_modulus():
    third = 2 * np.exp(2j * np.pi / 3)
    assert dense.leading(np.array([third, 2, third.conj(), 1.9])) == 1
    assert dense.leading(np.array([1, -3, 2])) == 1


def test_dominant_equals_a_full_decomposition():
    a = some(3, 40, 40)
    value, x = dense.dominant(lambda v: a @ v, np.ones(40))
    values = np.linalg.eigvals(a)
    assert value == pytest.approx(values[np.argmax(np.abs(values))], rel=1e-9)
    assert np.allclose(a @ x, value * x, atol=1e-9)


@pytest.mark.parametrize("mirrored", [False, True])
def test_environments_solve_their_rows(spark, mirrored):
    rows, columns = 3, 2
    a, m = some(1, 3, 2, 3, rows, columns), some(2, 2, 2, 2, 2, rows, columns)
    upper = packed(spark, ("AL", a), ("AR", a), ("M", m))
    got = found(environments.environments(upper, environments.conjugated(upper), rows=rows, mirrored=mirrored))
    for i in range(rows):
        low = rows - 1 - i if mirrored else (i + 1) % rows
        for j in range(columns):
            t = [a[..., i, j], m[..., i, j], a[..., low, j].conj()]
            left = np.einsum("adf,abc,dgeb,fgh->ceh", got["FL", i, j], *t)
            assert np.allclose(left, got["VL", i, 0] * got["FL", i, (j + 1) % columns], atol=1e-8)
            right = np.einsum("ceh,abc,dgeb,fgh->adf", got["FR", i, j], *t)
            assert np.allclose(right, got["VR", i, 0] * got["FR", i, (j - 1) % columns], atol=1e-8)
        assert got["VL", i, 0] == pytest.approx(got["VR", i, 0], rel=1e-8)


def test_centres_solve_their_columns(spark):
    rows, columns = 2, 3
    ac, m, c = some(1, 3, 2, 3, rows, columns), some(2, 2, 2, 2, 2, rows, columns), some(3, 3, 3, rows, columns)
    fl, fr = some(4, 3, 2, 3, rows, columns), some(5, 3, 2, 3, rows, columns)
    got = found(environments.centres(packed(spark, ("AC", ac), ("M", m), ("C", c), ("FL", fl), ("FR", fr)), columns))
    for i, j in np.ndindex(rows, columns):
        x = np.einsum("adf,abc,dgeb,ceh->fgh", fl[..., i, j], got["AC", i, j], m[..., i, j], fr[..., i, j])
        assert np.allclose(x, got["VA", 0, j] * got["AC", (i + 1) % rows, j], atol=1e-8)
        y = np.einsum("acd,ab,bce->de", fl[..., i, (j + 1) % columns], got["C", i, j], fr[..., i, j])
        assert np.allclose(y, got["VC", 0, j] * got["C", (i + 1) % rows, j], atol=1e-8)


def test_gauges_and_canonical_forms(spark):
    a = some(7, 3, 2, 3, 2, 2)
    left = found(environments.left_orthogonal(packed(spark, ("A", a))))
    right = found(environments.right_orthogonal(packed(spark, ("A", a))))
    for i, j in np.ndindex(2, 2):
        al, ar, x = left["AL", i, j], right["AR", i, j], a[..., i, j]
        assert np.allclose(np.einsum("cda,cdb->ab", al.conj(), al), np.eye(3))
        assert np.allclose(np.einsum("acd,bcd->ab", ar, ar.conj()), np.eye(3))
        assert np.allclose(left["NL", i, j] * np.tensordot(al, left["L", i, j], 1), np.tensordot(left["L", i, j], x, 1), atol=1e-8)
        assert np.allclose(right["NR", i, j] * np.tensordot(right["R", i, j], ar, 1), np.tensordot(x, right["R", i, j], 1), atol=1e-8)
    # a centre that is exactly AL C (and C AR in a one-column cell) gives back AL
    c = some(8, 3, 3, 2, 2)
    al = np.stack([np.stack([left["AL", i, j] for j in range(2)], -1) for i in range(2)], -2)
    ac = np.einsum("ascij,cbij->asbij", al, c)
    got = found(environments.canonical(packed(spark, ("AC", ac), ("C", c)), 2))
    for i, j in np.ndindex(2, 2):
        assert np.allclose(got["AL", i, j], left["AL", i, j], atol=1e-8)
        assert abs(got["EL", i, j]) < 1e-8
        assert np.allclose(np.einsum("acd,bcd->ab", got["AR", i, j], got["AR", i, j].conj()), np.eye(3))


def test_packing_fills_zeros_and_unpacks(spark):
    df = spark.createDataFrame([(1, 0, 5, 0, 0, 2.0, -1.0)], "a int, b int, problem bigint, i int, j int, re double, im double")
    t = Tensor(df, ("a", "b"), {"a": 2, "b": 3}, cells.KEYS)
    p = cells.pack(t, "X")
    row = p.first()
    assert row.shape == [2, 3] and row.re == [0, 0, 0, 2.0, 0, 0] and row.im == [0, 0, 0, -1.0, 0, 0]
    back = cells.unpack(p, "X", "ab", (2, 3)).df.where("re <> 0").collect()
    assert [(r.a, r.b, r.re, r.im) for r in back] == [(1, 0, 2.0, -1.0)]
    assert cells.pack(t._with(df.where("false")), "X").count() == 0


def test_stop_counts_the_guess_as_state_zero():
    halve = lambda x: (x / 2, x / 2)
    assert variational.fixed_point(halve, 1.0, variational.Stop(0.0, 3)) == (0.125, 0.125)
    assert variational.fixed_point(halve, 1.0, variational.Stop(0.3, 10)) == (0.25, 0.25)
    assert variational.fixed_point(halve, 1.0, variational.Stop(1.0, 10, 4)) == (0.0625, 0.0625)
    assert variational.fixed_point(halve, 1.0, variational.Stop(1.0, 0)) == (1.0, float("inf"))


def test_ising_fixed_point_and_checkpoint(spark, tmp_path):
    beta, chi = 0.6, 6
    betas = spark.createDataFrame([(beta,)], "beta double")

    def network(tensor):
        t = tensor(betas, "dgeb")
        df = t.df.select(*t.index, F.lit(1).cast("long").alias("problem"), F.lit(0).alias("i"), F.lit(0).alias("j"), "re", "im")
        return Tensor(df, t.index, t.dims, cells.KEYS)

    bulk = network(ising.bulk)
    seen = []
    state, error = variational.solve(variational.start(bulk, chi, 1, 1), 1, 1, tol=1e-9, maxiter=10, after=lambda s, e: seen.append(1))
    assert error < 1e-9 and 1 <= len(seen) <= 10
    variational.save(state, str(tmp_path), "up", chi, 2)
    state = variational.load(spark, str(tmp_path), "up", chi, 2)
    s = np.sin((np.arange(4000) + 0.5) * np.pi / 8000)
    k = 2 * np.sinh(2 * beta) / np.cosh(2 * beta) ** 2
    root = np.sqrt(1 - (k * s) ** 2)
    z = np.sqrt(2) * np.cosh(2 * beta) * np.exp(np.log(1 + root).mean() / 2)
    energy = -(1 + (2 * np.tanh(2 * beta) ** 2 - 1) * (1 / root).mean()) / np.tanh(2 * beta)
    assert variational.partition_per_site(state, bulk, chi, 1, 1).first().z == pytest.approx(z, abs=1e-7)
    env = variational.observing(state, None, 1)
    value = lambda t: variational.expectation(state, env, network(t), bulk, chi, 1).first()
    assert value(ising.energy).re == pytest.approx(energy, abs=1e-6)
    assert abs(value(ising.magnetic).re) == pytest.approx((1 - np.sinh(2 * beta) ** -4) ** 0.125, abs=1e-6)
    by_entry = variational.gradient(state, env, bulk, chi, 1, 1)
    along = lambda t: contract((by_entry, t)).df.first().re
    assert along(bulk) == pytest.approx(1, abs=1e-10)
    assert along(network(ising.bulk_slope)) == pytest.approx(-energy, abs=1e-6)
    # one entry moved either way, as two problems that start from this state
    step, both = 1e-4, F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>"))
    first = F.greatest(*bulk.index) == 0
    ends = bulk.df.drop("problem").withColumn("problem", both)
    ends = bulk._with(ends.withColumn("re", F.when(first, F.col("re") + (F.col("problem") * 2 - 1) * step).otherwise(F.col("re"))))
    old = state.where("name <> 'M'").withColumn("problem", both).unionByName(variational.normalized_bulk(ends))
    moved, _ = variational.solve(old, 1, 1, tol=1e-7, maxiter=3)  # the boundary's error counts squared
    z = {r.problem: r.z for r in variational.partition_per_site(moved, ends, chi, 1, 1).collect()}
    got = by_entry.df.where(F.greatest(*by_entry.index) == 0).first()
    assert np.log(z[1] / z[0]) / (2 * step) == pytest.approx(got.re, abs=1e-5) and abs(got.im) < 1e-9
    # from a kept state nothing is left to do
    assert variational.solve(state, 1, 1, tol=1e-8, maxiter=1)[1] < 1e-8
    state.write.parquet(f"{tmp_path}/direction=up/D=2/chi=7")
    with pytest.raises(ValueError, match="dimension 7"):
        variational.load(spark, str(tmp_path), "up", 7, 2)
