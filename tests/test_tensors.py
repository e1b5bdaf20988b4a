import numpy as np
import pytest

import __spark_entry__
from tessellar.operators import ising, maps
from tessellar.operators.contract import contract
from tessellar.operators.factor import lqpos, qrpos
from tessellar.operators.tensor import Tensor

CELL = 2


def make(spark, x, index, batch=("i", "j")):
    rows = [(*map(int, k), float(v.real), float(v.imag)) for k, v in np.ndenumerate(x)]
    names = [*index, *batch]
    df = spark.createDataFrame(rows, ", ".join(f"{k} int" for k in names) + ", re double, im double")
    return Tensor(df, tuple(index), dict(zip(index, x.shape, strict=False)), tuple(batch))


def dense(t, shape):
    out = np.zeros(shape, complex)
    for r in t.df.collect():
        out[tuple(r[k] for k in t.keys)] += r.re + 1j * r.im
    return out


def some(seed, *shape):
    g = np.random.default_rng(seed)
    return g.normal(size=shape) + 1j * g.normal(size=shape)


def test_left_map_is_the_drawn_sum(spark):
    fl, au, m, ad = (some(k, *s, CELL, CELL) for k, s in enumerate([(3, 2, 3), (3, 2, 3), (2, 2, 2, 2), (3, 2, 3)]))
    got = maps.left_map(make(spark, fl, "adf"), make(spark, au, "abc"), make(spark, m, "dgeb"), maps.below(make(spark, ad, "fgh"), CELL), CELL)
    want = np.einsum("adfij,abcij,dgebij,fghij->cehij", fl, au, m, np.roll(ad, -1, axis=3))
    assert np.allclose(dense(got, want.shape), np.roll(want, 1, axis=4))


def test_bond_map_and_shared_index_of_three(spark):
    fl, c, fr = some(1, 3, 2, 3, CELL, CELL), some(2, 3, 3, CELL, CELL), some(3, 3, 2, 3, CELL, CELL)
    got = maps.bond_map(make(spark, c, "ab"), make(spark, fl, "adf"), make(spark, fr, "ceh"), CELL, CELL)
    want = np.roll(np.einsum("acdij,abij,bceij->deij", np.roll(fl, -1, axis=4), c, fr), 1, axis=2)
    assert np.allclose(dense(got, want.shape), want)
    x = some(4, 2, 3)
    t = contract(((make(spark, x, "si"[:1] + "a", ()), make(spark, x, "sb", ())), make(spark, x, "sc", ())), "abc")
    assert np.allclose(dense(t, (3, 3, 3)), np.einsum("sa,sb,sc->abc", x, x, x))


def test_factors_have_a_positive_diagonal(spark):
    a = some(5, 4, 2, 3, 1, 2)
    q, r = qrpos(make(spark, a, "abc"), "c")
    qd, rd = dense(q, a.shape), dense(r, (3, 3, 1, 2))
    assert np.allclose(np.einsum("abcij,czij->abzij", qd, rd), a)
    assert np.all(np.einsum("ccij->cij", rd).real > 0) and np.allclose(np.einsum("ccij->cij", rd).imag, 0)
    assert np.allclose(np.einsum("abcij,abzij->czij", qd.conj(), qd)[..., 0, 0], np.eye(3))
    b = some(6, 3, 2, 4, 1, 1)
    l, q = lqpos(make(spark, b, "abc"), "a")
    assert np.allclose(np.einsum("azij,zbcij->abcij", dense(l, (3, 3, 1, 1)), dense(q, b.shape)), b)


def test_ising_energy_is_the_derivative_of_the_bulk(spark):
    beta, step = 0.5, 1e-4
    betas = spark.createDataFrame([(beta - step,), (beta,), (beta + step,)], "beta double")
    trace = lambda t: {r.beta: r.re for r in t.df.where("a = c and b = d").groupBy("beta").agg({"re": "sum"}).withColumnRenamed("sum(re)", "re").collect()}
    z, e = trace(ising.bulk(betas)), trace(ising.energy(betas))
    assert e[beta] == pytest.approx(-(z[beta + step] - z[beta - step]) / (2 * step), rel=1e-6)


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() == 288
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)
