"""Eigenvectors, solves and factors whose vectors are tables, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.operators import krylov, tall
from tessellar.operators.contract import contract
from tessellar.operators.tensor import Tensor

from .test_tensors import some


def table(spark, x, index, batch=("problem",)):
    rows = [(*map(int, k), float(v.real), float(v.imag)) for k, v in np.ndenumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} int" for k in (*index, *batch)) + ", re double, im double")
    return Tensor(df, tuple(index), dict(zip(index, x.shape, strict=False)), tuple(batch))


def array(t, shape):
    out = np.zeros(shape, complex)
    for r in t.df.collect():
        out[tuple(r[k] for k in t.keys)] += r.re + 1j * r.im
    return out


def product(m):
    return lambda x: contract((m, x.rename("b")), "a").rename("a")


def matrices(*values, seed=1):
    """A matrix for each list of eigenvalues."""
    out = []
    for k, v in enumerate(values):
        s = some(seed + k, len(v), len(v))
        out.append(s @ np.diag(v) @ np.linalg.inv(s))
    return np.stack(out, axis=-1)


def test_arnoldi_on_tables(spark):
    m = matrices([3, 0.2j, -0.1, 0.02, 0.1, 0.1], [1j, 0.01, 0.05, 0.03, 0.02, 0.01])
    values, x = krylov.dominant(product(table(spark, m, "ab")), table(spark, some(9, 6, 2), "a"), space=5, tol=1e-10)
    found = {r.problem: r.vr + 1j * r.vi for r in values.collect()}
    assert found[0] == pytest.approx(3, abs=1e-9) and found[1] == pytest.approx(1j, abs=1e-9)
    x = array(x, (6, 2))
    for p in (0, 1):
        assert np.allclose(m[..., p] @ x[:, p], found[p] * x[:, p], atol=1e-9) and np.linalg.norm(x[:, p]) == pytest.approx(1)


def test_arnoldi_ends_in_a_closed_space(spark):
    m = np.diag([2.0, 1.0, 5.0])[..., None].astype(complex)
    values, _ = krylov.dominant(product(table(spark, m, "ab")), table(spark, np.array([[1.0], [1.0], [0.0]]), "a"), space=6)
    assert [r.vr for r in values.collect()] == [pytest.approx(2)]
    none = table(spark, np.zeros((3, 1)), "a")
    assert krylov.dominant(product(table(spark, m, "ab")), none)[0].count() == 0


def test_subspace_iteration_of_one_modulus(spark):
    """Three eigenvalues of one modulus, which no single vector settles on; the largest real part comes first."""
    third = np.exp(2j * np.pi / 3)
    m = matrices([2 * third, 2, 2 * third.conj(), 0.2, 0.01], [-3.0, 3.0, 0.3, 0.02, 0.001], seed=4)
    guesses = [table(spark, some(20 + k, 5, 2), "a") for k in range(4)]  # one more than is asked for
    values, vectors = krylov.leading(product(table(spark, m, "ab")), guesses, 3, inner=3)
    found = {(r.problem, r.k): r.vr + 1j * r.vi for r in values.collect()}
    assert [found[0, k] for k in range(3)] == [pytest.approx(2, abs=1e-8), pytest.approx(2 * third, abs=1e-8), pytest.approx(2 * third.conj(), abs=1e-8)]
    assert [found[1, k] for k in range(3)] == [pytest.approx(3, abs=1e-8), pytest.approx(-3, abs=1e-8), pytest.approx(0.3, abs=1e-5)]
    x = array(vectors._with(vectors.df.where("k = 0")), (5, 2, 4))[..., 0]
    assert np.allclose(m[..., 0] @ x[:, 0], 2 * x[:, 0], atol=1e-7) and np.allclose(m[..., 1] @ x[:, 1], 3 * x[:, 1], atol=1e-7)


def test_gmres_on_tables(spark):
    m, b = some(5, 7, 7, 2) + 4 * np.eye(7)[..., None], some(6, 7, 2)
    b[:, 1] = 0
    x, left = krylov.solve(product(table(spark, m, "ab")), table(spark, b, "a"), space=7)
    assert np.allclose(m[..., 0] @ array(x, (7, 2))[:, 0], b[:, 0], atol=1e-9)
    assert all(r.residual < 1e-11 for r in left.collect()) and not array(x, (7, 2))[:, 1].any()


def test_gmres_in_a_complement(spark):
    """A singular map: the goal's part that it can't reach goes, and so does the solution's along its null vector."""
    m = matrices([0, 2, 3, 1j])
    right = np.linalg.svd(m[..., 0])[2][-1].conj()
    left = np.linalg.svd(m[..., 0].conj().T)[2][-1].conj()
    along, dual = table(spark, right[:, None], "a"), table(spark, left[:, None], "a")
    b = some(7, 4, 1)
    x, _ = krylov.solve(product(table(spark, m, "ab")), table(spark, b, "a"), along=along, dual=dual, space=3)
    x = array(x, (4, 1))[:, 0]
    reach = b[:, 0] - right * (left.conj() @ b[:, 0]) / (left.conj() @ right)
    assert np.allclose(m[..., 0] @ x, reach, atol=1e-9) and abs(left.conj() @ x) < 1e-9


@pytest.mark.parametrize("condition", [1e2, 1e10])
def test_tall_qr(spark, monkeypatch, condition):
    monkeypatch.setattr(tall, "FAN", 2)
    monkeypatch.setattr(tall, "ROWS", 3)
    x = np.zeros((4, 6, 3, 1, 2), complex)
    for p in range(2):
        u, _, v = np.linalg.svd(some(8 + p, 24, 3), full_matrices=False)
        x[..., 0, p] = (u * np.geomspace(1, 1 / condition, 3) @ v).reshape(4, 6, 3)
    a = table(spark, x, "abc", ("i", "problem"))
    a = a._with(a.df.repartition(7))
    q, r = tall.tall_qr(a, "c")
    q, r = array(q, (4, 6, 3, 1, 2)), array(r, (3, 3, 1, 2))
    for p in range(2):
        f, g = q[..., 0, p].reshape(24, 3), r[..., 0, p]
        assert np.allclose(f.conj().T @ f, np.eye(3), atol=1e-12) and np.allclose(f @ g, x[..., 0, p].reshape(24, 3), atol=1e-14)
        assert not np.tril(g, -1).any() and (np.diag(g).real > 0).all() and np.allclose(np.diag(g).imag, 0)


def test_tall_lq_and_fewer_rows_than_columns(spark):
    x = some(3, 2, 3, 3, 1)
    l, q = tall.tall_lq(table(spark, x, "abc"), "a")
    l, q = array(l, (2, 2, 1))[..., 0], array(q, (2, 3, 3, 1))[..., 0].reshape(2, 9)
    assert np.allclose(l @ q, x[..., 0].reshape(2, 9)) and np.allclose(q @ q.conj().T, np.eye(2)) and not np.triu(l, 1).any()
    r = tall.tall_r(table(spark, some(4, 1, 3, 1), "ab"), "b")
    assert r.count() == 3
    assert tall.tall_r(table(spark, np.zeros((0, 3, 1)), "ab"), "b").count() == 0


@pytest.mark.parametrize("n", [2, 4])
def test_svd(spark, n):
    x = some(11, 3, 2, n, 2)
    x[..., 1] = x[..., 1] * np.geomspace(1, 1e-6, n)
    if n == 4:
        x[:, :, 3, 0] = x[:, :, 1, 0] * (1 + 1j)  # rank 3
    u, s, v = tall.svd(table(spark, x, "abc"), "c")
    got = sorted((r.problem, r.c, r.s) for r in s.collect())
    for p in range(2):
        want = np.linalg.svd(x[..., p].reshape(6, n))[1]
        assert np.allclose([r[2] for r in got if r[0] == p], want, rtol=1e-10, atol=1e-12)
    u, v = array(u, (3, 2, n, 2)), array(v, (n, n, 2))
    for p in range(2):
        values = np.array([r[2] for r in got if r[0] == p])
        assert np.allclose((u[..., p].reshape(6, n) * values) @ v[..., p].conj().T, x[..., p].reshape(6, n), atol=1e-12)
        assert np.allclose(v[..., p].conj().T @ v[..., p], np.eye(n), atol=1e-12)


def test_rounds_hold_every_pair_once():
    for n in range(2, 9):
        rounds = tall._rounds(n)
        assert all(len({k for p in r for k in p}) == 2 * len(r) for r in rounds)
        assert sorted(p for r in rounds for p in r) == [(a, b) for a in range(n) for b in range(a + 1, n)]


@pytest.mark.parametrize("block", [1, 2, 9])
def test_back_substitution(spark, block):
    r, b = np.triu(some(12, 5, 5) + 3 * np.eye(5))[..., None], some(13, 5, 3, 1)
    x = tall.back_substituted(table(spark, r, "zc"), table(spark, b, "zw"), block)
    assert x.index == ("c", "w") and np.allclose(array(x, (5, 3, 1))[..., 0], np.linalg.solve(r[..., 0], b[..., 0]))
