"""Numerical gradients in a sweep, and the tape's against them: contractions, norms, factors, environments and all of them composed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.operators import differences, maps
from tessellar.operators.cells import KEYS
from tessellar.operators.tape import Tape
from tessellar.operators.tensor import Tensor

from .test_tensors import dense, some


def lift(spark, x, index, problems=(0,)):
    """One tensor, with the cell's row and column last, for each problem."""
    rows = [(*map(int, k), p, float(v.real), float(v.imag)) for p in problems for k, v in np.ndenumerate(x)]
    names = ", ".join(f"{k} int" for k in (*index, "i", "j"))
    df = spark.createDataFrame(rows, f"{names}, problem bigint, re double, im double")
    return Tensor(df.select(*index, *KEYS, "re", "im"), tuple(index), dict(zip(index, x.shape, strict=False)), KEYS)


def flat(t, shape):
    return dense(Tensor(t.df.drop("problem"), t.index, t.dims, ("i", "j")), shape)


def values(node):
    return node.value.df.select("problem", F.col("re").alias("value"))


def same(x, y, atol):
    assert np.abs(y).max() > 1e-3
    assert np.allclose(x, y, atol=atol), np.abs(x - y).max()


def against_differences(x, loss, shape, atol=1e-6):
    """The tape's gradient of ``loss(tape, leaf, lifted)`` and the numerical one."""
    tape = Tape()
    leaf = tape.leaf(x)
    got = flat(tape.gradient(loss(tape, leaf, lambda t: t), [leaf])[0], shape)

    def value(t, bases):
        tape = Tape()
        return values(loss(tape, tape.leaf(t), lambda other: differences.lifted(other, bases)))

    same(got, flat(differences.num_grad_tensor(value, x), shape), atol)


def overlap(tape, x, s, form):
    """Sum over cells of |x s x / x x| (without conjugation), as a loss that norm and phase of x don't change."""
    index = x.value.index
    twin = dict(zip(index, "tuvw", strict=False))
    y = tape.rename(x, *twin.values())
    a = tape.contract(((x, tape.leaf(s.rename(*index, *twin.values()))), y), ())
    b = tape.contract((x, x), ())
    return tape.total(tape.modulus(tape.divide(a, b)))


def test_num_grad_of_scalars_and_arrays(spark):
    rows = spark.createDataFrame([(1, 3.0), (2, -2.0), (7, 0.5)], "problem bigint, re double")
    got = differences.num_grad(lambda t: t.select("problem", (F.col("re") * F.col("re")).alias("value")), rows, parts=1)
    assert {r.problem: r.re for r in got.collect()} == {1: pytest.approx(6), 2: pytest.approx(-4), 7: pytest.approx(1)}
    # the trace of matrices of several sizes, complex, problems with negative numbers, one without a value
    entries = [(p, a, b, 1.0 * a, 2.0 * b) for p, n in ((-3, 2), (5, 3), (6, 1)) for a in range(n) for b in range(n)]
    rows = spark.createDataFrame(entries, "problem bigint, a int, b int, re double, im double")
    trace = lambda t: t.where("a = b and base <> 6").groupBy("problem").agg(F.sum(F.col("re") + 2 * F.col("im")).alias("value"))
    for r in differences.num_grad(trace, rows, ("a", "b")).collect():
        on = None if r.problem == 6 else float(r.a == r.b)
        assert r.re == (on if on is None else pytest.approx(on, abs=1e-8)) and r.im == (on if on is None else pytest.approx(2 * on, abs=1e-8))
    none = rows.limit(0)
    assert differences.num_grad(trace, none, ("a", "b")).count() == 0


def test_contraction_norms_and_quotients(spark):
    """Rank-6 form, entries of the batch, an index of three factors, one that is summed alone, and per-cell norms."""
    x = some(1, 2, 2, 3, 2, 1)
    s = lift(spark, some(2, 2, 2, 3, 2, 2, 3, 2, 1), "abctuv")
    against_differences(lift(spark, x, "abc"), lambda tape, n, up: overlap(tape, n, up(s), 3), x.shape)
    y, z = lift(spark, some(3, 2, 4, 2, 1), "ad"), lift(spark, some(4, 2, 3, 2, 1), "ac")

    def shared(tape, n, up):
        three = tape.contract(((n, tape.leaf(up(y))), tape.leaf(up(z))), "b")
        alone = tape.contract((tape.scale(tape.conj(n), 0.5, 2.0), tape.leaf(up(y))), "c")
        both = tape.add(tape.norm(three), tape.norm(alone))
        return tape.total(tape.add(both, tape.norm(tape.shift(n, "i", 1, 2))))

    against_differences(lift(spark, x, "abc"), shared, x.shape)

    def normal(tape, n, up):
        return tape.total(tape.norm(tape.contract((tape.normalized(n), tape.leaf(up(y))), "cd")))

    against_differences(lift(spark, x, "abc"), normal, x.shape)


def test_norm_of_nothing_has_no_slope(spark):
    tape = Tape()
    leaf = tape.leaf(lift(spark, np.zeros((2, 1, 1), complex), "a"))
    for loss in (tape.norm(leaf), tape.total(tape.modulus(leaf))):
        assert not flat(tape.gradient(loss, [leaf])[0], (2, 1, 1)).any()


def test_tape_equals_the_maps_derivatives(spark):
    """The seven hand-made derivatives are the tape's entries, less their sign and conjugation."""
    n = 2
    fl, fr = (lift(spark, some(k, 3, 2, 3, n, n), index) for k, index in ((1, "adf"), (2, "ceh")))
    au, ad, m = lift(spark, some(3, 3, 2, 3, n, n), "abc"), lift(spark, some(4, 3, 2, 3, n, n), "fgh"), lift(spark, some(5, 2, 2, 2, 2, n, n), "dgeb")
    tape = Tape()
    nodes = [tape.leaf(t) for t in (fl, au, m, ad, fr)]
    whole = tape.contract(((((nodes[0], nodes[1]), nodes[2]), nodes[3]), nodes[4]), ())
    got = tape.gradient(whole, nodes)
    want = [maps.d_left(au, fr, m, ad), maps.d_upper(fl, ad, m, fr), maps.d_bulk(fl, au, ad, fr), maps.d_lower(fl, au, m, fr), maps.d_right(au, fl, m, ad)]
    for g, w, t in zip(got, want, (fl, au, m, ad, fr), strict=True):
        shape = (*(t.dims[k] for k in t.index), n, n)
        same(flat(g, shape), -flat(w, shape), 1e-9)


def test_factors(spark):
    x = some(6, 2, 2, 2, 1, 1)
    u, v = lift(spark, some(7, 2, 2, 2, 1, 1), "aby"), lift(spark, some(8, 2, 2, 1, 1), "yc")

    def qr(tape, n, up):
        q, r = tape.factors(n, "c", "y")
        return tape.total(tape.add(tape.modulus(tape.contract((q, tape.leaf(up(u))))), tape.modulus(tape.contract((r, tape.leaf(up(v)))))))

    against_differences(lift(spark, x, "abc"), qr, x.shape)

    def lq(tape, n, up):
        q, l = tape.factors(n, "a", "y", left=False)
        return tape.total(tape.modulus(tape.contract((tape.contract((q, l), "abc"), tape.leaf(up(lift(spark, some(9, 2, 2, 2, 1, 1), "abc")))))))

    against_differences(lift(spark, x, "abc"), lq, x.shape)


def test_environments(spark):
    """Left and right environments, centre and bond by the bulk tensor, through rank-6 and rank-4 forms."""
    m = some(10, 2, 2, 2, 2, 1, 2)
    a, b = lift(spark, some(11, 2, 2, 2, 1, 2), "abc"), lift(spark, some(12, 2, 2, 2, 1, 2), "fgh")
    s, t = lift(spark, some(13, 2, 2, 2, 2, 2, 2, 1, 2), "abctuv"), lift(spark, some(14, 2, 2, 2, 2, 1, 2), "abtu")

    def loss(tape, n, up):
        state, lower = tape.leaf(up(a)), tape.leaf(up(b))
        fl = tape.environment(state, n, lower, 1, 2)
        fr = tape.environment(state, n, lower, 1, 2, left=False)
        c = tape.bonds(lift_like(up, b, "ab"), fl, n.value, fr, 1, 2)
        ac = tape.centres(up(a), fl, n, fr, 1, 2)
        parts = [overlap(tape, x, up(f), k) for x, f, k in ((fl, s, 3), (fr, s, 3), (ac, s, 3), (c, t, 2))]
        return tape.add(tape.add(parts[0], parts[1]), tape.add(parts[2], parts[3]))

    def lift_like(up, like, index):
        return up(lift(spark, np.ones((2, 2, 1, 2), complex), index))

    against_differences(lift(spark, m, "dgeb"), loss, m.shape, atol=1e-5)


def test_gradient_through_the_canonical_forms(spark):
    """Centre from its map, then left and right isometries nearest to centre and bond, all three in the loss."""
    m = some(20, 2, 2, 2, 2, 1, 1)
    fl, fr = lift(spark, some(21, 2, 2, 2, 1, 1), "adf"), lift(spark, some(22, 2, 2, 2, 1, 1), "ceh")
    guess, bond, s = lift(spark, some(23, 2, 2, 2, 1, 1), "abc"), lift(spark, some(24, 2, 2, 1, 1), "ab"), lift(spark, some(25, 2, 2, 2, 2, 2, 2, 1, 1), "abctuv")

    def loss(tape, n, up):
        ac = tape.centres(up(guess), tape.leaf(up(fl)), n, tape.leaf(up(fr)), 1, 1)
        al, ar = tape.isometries(ac, tape.leaf(up(bond)), 1)
        parts = [overlap(tape, x, up(s), 3) for x in (al, ar, ac)]
        return tape.add(tape.add(parts[0], parts[1]), parts[2])

    against_differences(lift(spark, m, "dgeb"), loss, m.shape, atol=1e-5)
