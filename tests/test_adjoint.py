import numpy as np
import pytest

from tessellar.functions import dense
from tessellar.operators import adjoint, environments

from .test_networks import found, packed
from .test_tensors import some


def overlap(x, w):
    """A real loss that neither norm nor phase of x changes, and its cotangent at x of norm 1."""
    s = np.vdot(w, x)
    return abs(s) ** 2 / np.vdot(x, x).real, s * w


def slope(f, x, at, step=1e-5):
    """Derivatives of f by the real and the imaginary part of an entry of x."""
    out = []
    for d in (step, 1j * step):
        ends = []
        for sign in (1, -1):
            y = x.copy()
            y[at] += sign * d
            ends.append(f(y))
        out.append((ends[0] - ends[1]) / (2 * step))
    return complex(*out)


def test_left_and_right_environments(spark):
    a, b, m = some(1, 3, 2, 3, 1, 2), some(2, 3, 2, 3, 1, 2), some(3, 2, 2, 2, 2, 1, 2)
    w = some(4, 2, 3, 2, 3)
    upper, lower = packed(spark, ("AL", a), ("AR", a), ("M", m)), packed(spark, ("AL", b), ("AR", b))
    env = found(environments.environments(upper, lower))

    def left(m):
        return np.stack(dense.cyclic([lambda x, j=j: dense.left_step(x, a[..., 0, j], m[..., 0, j], b[..., 0, j]) for j in range(2)], np.ones((3, 2, 3)))[1])

    def right(m):
        return np.stack(dense.cyclic([lambda x, j=j: dense.right_step(x, a[..., 0, j], m[..., 0, j], b[..., 0, j]) for j in (1, 0)], np.ones((3, 2, 3)))[1][::-1])

    for name, value, solve, function in (("FL", "VL", left, adjoint.left_cotangents), ("FR", "VR", right, adjoint.right_cotangents)):
        f = np.stack([env[name, 0, j] for j in range(2)])
        g = np.moveaxis(overlap(f, w)[1], 0, -1)[..., None, :]
        cells = packed(spark, (name, np.moveaxis(f, 0, -1)[..., None, :]), ("DF", g)).unionByName(packed(spark, (value, env[value, 0, 0].reshape(1, 1))))
        x = found(function(upper, lower, cells, 1))
        for j in range(2):
            ends = (f[j], x["X", 0, (j + 1) % 2].conj()) if name == "FL" else (x["X", 0, (j - 1) % 2].conj(), f[j])
            got = -np.einsum("adf,abc,fgh,ceh->dgeb", ends[0], a[..., 0, j], b[..., 0, j], ends[1]).conj()
            want = slope(lambda y, solve=solve: overlap(solve(y), w)[0], m, (1, 0, 1, 1, 0, j))
            assert 2 * got[1, 0, 1, 1] == pytest.approx(want, rel=1e-5, abs=1e-7)


def test_centres_and_bonds(spark):
    ac, m, c = some(1, 3, 2, 3, 2, 1), some(2, 2, 2, 2, 2, 2, 1), some(3, 3, 3, 2, 1)
    fl, fr = some(4, 3, 2, 3, 2, 1), some(5, 3, 2, 3, 2, 1)
    parts = packed(spark, ("AC", ac), ("M", m), ("C", c), ("FL", fl), ("FR", fr))
    t = found(environments.centres(parts, 1))
    fixed = packed(spark, ("M", m), ("FL", fl), ("FR", fr))

    def centre(fr):
        return np.stack(dense.cyclic([lambda x, i=i: dense.centre_step(x, fl[..., i, 0], m[..., i, 0], fr[..., i, 0]) for i in range(2)], ac[..., 0, 0])[1])

    def bond(fr):
        return np.stack(dense.cyclic([lambda x, i=i: dense.bond_step(x, fl[..., i, 0], fr[..., i, 0]) for i in range(2)], c[..., 0, 0])[1])

    for name, value, solve, w in (("AC", "VA", centre, some(6, 2, 3, 2, 3)), ("C", "VC", bond, some(7, 2, 3, 3))):
        f = np.stack([t[name, i, 0] for i in range(2)])
        g = np.moveaxis(overlap(f, w)[1], 0, -1)[..., None]
        cells = fixed.unionByName(packed(spark, (name, np.moveaxis(f, 0, -1)[..., None]), ("DF", g))).unionByName(packed(spark, (value, t[value, 0, 0].reshape(1, 1))))
        x = found(adjoint.centre_cotangents(cells) if name == "AC" else adjoint.bond_cotangents(cells, 1))
        for i in range(2):
            y = x["X", (i + 1) % 2, 0].conj()
            if name == "AC":
                got = -np.einsum("adf,abc,dgeb,fgh->ceh", fl[..., i, 0], f[i], m[..., i, 0], y).conj()
            else:
                got = -np.einsum("acd,ab,de->bce", fl[..., i, 0], f[i], y).conj()
            want = slope(lambda z, solve=solve: overlap(solve(z), w)[0], fr, (2, 1, 0, i, 0))
            assert 2 * got[2, 1, 0] == pytest.approx(want, rel=1e-5, abs=1e-7)


def test_factors(spark):
    a, u, v = some(1, 4, 3, 1, 1), some(2, 4, 3, 1, 1), some(3, 3, 3, 1, 1)
    at = (2, 1, 0, 0)
    q = found(adjoint.factor_cotangents(packed(spark, ("A", a), ("DQ", u), ("DR", v))))["DA", 0, 0]

    def loss(x):
        one, two = dense.qr_positive(x[..., 0, 0])
        return 2 * (np.vdot(u, one) + np.vdot(v, two)).real

    assert 2 * q[2, 1] == pytest.approx(slope(loss, a, at), rel=1e-6)
    wide = a.transpose(1, 0, 2, 3)
    l = found(adjoint.factor_cotangents(packed(spark, ("A", wide), ("DQ", u.transpose(1, 0, 2, 3)), ("DL", v)), left=False))["DA", 0, 0]

    def mirrored(x):
        one, two = dense.qr_positive(x[..., 0, 0].conj().T)
        return 2 * (np.vdot(u[..., 0, 0].T, one.conj().T) + np.vdot(v[..., 0, 0], two.conj().T)).real

    assert 2 * l[1, 2] == pytest.approx(slope(mirrored, wide, (1, 2, 0, 0)), rel=1e-6)
