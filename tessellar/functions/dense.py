"""Numpy helpers for the small dense tensors of one group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Map = Callable[[np.ndarray], np.ndarray]


def leading(values: np.ndarray, close: float = 1e-12) -> int:
    """The position of the largest modulus; of equal ones that of the largest real part."""
    size = np.abs(values)
    near = np.flatnonzero(size.max() - size < close)
    return int(near[np.argmax(values[near].real)])


def dominant(apply: Map, guess: np.ndarray, tol: float = 1e-13, space: int = 24, restarts: int = 100) -> tuple[complex, np.ndarray]:
    """The eigenpair of largest modulus of a linear map, by restarted Arnoldi; the vector has norm 1."""
    x = guess.astype(complex).ravel()
    x = x / np.linalg.norm(x)
    most = min(space, x.size)
    for _ in range(restarts):
        basis, h = np.zeros((most + 1, x.size), complex), np.zeros((most + 1, most), complex)
        basis[0] = x
        for k in range(most):
            y = apply(basis[k].reshape(guess.shape)).ravel()
            scale = np.linalg.norm(y)
            for _ in range(2):
                part = basis[: k + 1].conj() @ y
                y = y - part @ basis[: k + 1]
                h[: k + 1, k] += part
            rest = np.linalg.norm(y)
            if rest <= 1e-14 * scale:
                break
            h[k + 1, k] = rest
            basis[k + 1] = y / rest
        values, vectors = np.linalg.eig(h[: k + 1, : k + 1])
        best = leading(values)
        x = vectors[:, best] @ basis[: k + 1]
        x = x / np.linalg.norm(x)
        if abs(h[k + 1, k] * vectors[-1, best]) <= tol * abs(values[best]):
            break
    return complex(values[best]), x.reshape(guess.shape)


def cyclic(steps: list[Map], guess: np.ndarray) -> tuple[complex, list[np.ndarray]]:
    """value * x[k + 1] = steps[k](x[k]) around a cycle.

    A map that moves every slot on has eigenvalues in multiplets of one
    modulus. The product of the steps acts on one slot and has a single leading
    one; its principal root is the multiplet's member of largest real part.
    """

    def around(x: np.ndarray) -> np.ndarray:
        for step in steps:
            x = step(x)
        return x

    value, x = dominant(around, guess)
    value = value ** (1 / len(steps))
    out = [x]
    for step in steps[:-1]:
        out.append(step(out[-1]) / value)
    total = sum(x.sum() for x in out)
    phase = total / abs(total) if abs(total) > 1e-8 else 1
    norm = np.sqrt(sum(np.linalg.norm(x) ** 2 for x in out)) * phase
    return value, [x / norm for x in out]


def left_step(env: np.ndarray, upper: np.ndarray, bulk: np.ndarray, lower: np.ndarray) -> np.ndarray:
    x = np.tensordot(env, upper, (0, 0))  # d f b c
    x = np.tensordot(x, bulk, ([0, 2], [0, 3]))  # f c g e
    return np.tensordot(x, lower, ([0, 2], [0, 1]))


def right_step(env: np.ndarray, upper: np.ndarray, bulk: np.ndarray, lower: np.ndarray) -> np.ndarray:
    x = np.tensordot(env, upper, (0, 2))  # e h a b
    x = np.tensordot(x, bulk, ([0, 3], [2, 3]))  # h a d g
    return np.tensordot(x, lower, ([0, 3], [2, 1]))


def centre_step(centre: np.ndarray, left: np.ndarray, bulk: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = np.tensordot(left, centre, (0, 0))  # d f b c
    x = np.tensordot(x, bulk, ([0, 2], [0, 3]))  # f c g e
    return np.tensordot(x, right, ([1, 3], [0, 1]))


def bond_step(bond: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.tensordot(np.tensordot(left, bond, (0, 0)), right, ([2, 0], [0, 1]))


def qr_positive(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """QR of a matrix with a positive diagonal of R (1 stands for the phase of a zero)."""
    q, r = np.linalg.qr(a)
    d = np.diag(r)
    phase = np.where(d == 0, 1, d / np.where(d == 0, 1, np.abs(d)))
    return q * phase, r * phase.conj()[:, None]


def left_gauge(a: np.ndarray, tol: float = 1e-12, maxiter: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """``q, l, size`` with size * q l = l a and q an isometry.

    The transfer matrix of ``a`` itself gives the first ``l``; after that each
    round takes the leading vector of the mixed transfer matrix and one QR.
    """
    n, d, _ = a.shape
    density = dominant(lambda x: np.tensordot(np.tensordot(x, a, (1, 0)), a.conj(), ([0, 1], [0, 1])).T, np.eye(n))[1]
    density = density + density.conj().T
    density = density / np.trace(density).real
    _, s, v = np.linalg.svd(density)
    l = qr_positive(np.sqrt(s)[:, None] * v)[1]
    for _ in range(maxiter):
        q, r = qr_positive(np.tensordot(l, a, 1).reshape(n * d, n))
        size = float(np.linalg.norm(r))
        new = r / size
        q = q.reshape(n, d, n)
        if np.linalg.norm(new - l / np.linalg.norm(l)) <= tol:
            return q, new, size
        mixed = dominant(lambda x, q=q: np.tensordot(q.conj(), np.tensordot(x, a, 1), ([0, 1], [0, 1])), new)[1]
        l = qr_positive(mixed)[1]
        l = l / np.linalg.norm(l)
    return q, new, size


def nearest_isometries(centre: np.ndarray, bond: np.ndarray, before: np.ndarray, i: int, j: int) -> dict:
    """``AL``, ``AR`` nearest to a cell's centre and the bonds after and before it, and what they miss as ``EL``, ``ER``."""
    ac, c, b = (x / np.linalg.norm(x) for x in (centre, bond, before))
    n, d, m = ac.shape
    q, r = qr_positive(ac.reshape(n * d, m))
    p, s = qr_positive(c)
    # the factors from the right are those of the adjoint
    y, u = qr_positive(ac.reshape(n, d * m).conj().T)
    x, v = qr_positive(b.conj().T)
    left, right = (q @ p.conj().T).reshape(n, d, m), (x @ y.conj().T).reshape(n, d, m)
    return {("AL", i, j): left, ("AR", i, j): right, ("EL", i, j): np.linalg.norm(r - s), ("ER", i, j): np.linalg.norm(u - v)}


def outside(t: dict, i: int, j: int, rows: int) -> float:
    """What the centre's map, once down through all rows, leaves outside the tangent space of the state at a cell."""
    x = np.tensordot(t["AL", i, j], t["C", i, j], 1)
    for k in range(i, i + rows):
        k %= rows
        x = centre_step(x, t["FL", k, j], t["M", k, j], t["FR", k, j])
    ar = t["AR", i, j]
    return np.linalg.norm(x - np.tensordot(np.tensordot(x, ar.conj(), ([1, 2], [1, 2])), ar, 1))
