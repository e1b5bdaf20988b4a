"""Gradients through the environments: one linear solve a row or column.

For value * F = T(A, M, B) F, a change of T moves F within the complement of F
by -(T - value)^-1 dT F. So a cotangent dF of F gives dT the cotangent of
-x F, where x solves (T - value)' x = dF less its part along F. The solve is a grouped
map; what it gives the factors are the contractions of ``maps``.

Cotangents are Wirtinger's: for a real loss, d loss = 2 re sum(conj(g) dz) with
the entries' ``g``. F's norm and phase are held, so the loss mustn't depend on them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dense
from ..functions.ship import ship
from .cells import SCHEMA, moved, read, write
from .environments import _below, _next_left, _only


def complement_solve(apply: Callable[[np.ndarray], np.ndarray], value: complex, x: np.ndarray, left: np.ndarray, right: np.ndarray, tol: float = 1e-13, space: int = 200) -> np.ndarray:
    """(apply - value) y = x for an x without a part along ``left``, by GMRES; y has none along ``left``.

    ``left`` and ``right`` are the leading eigenvectors of the map and of its adjoint.
    """
    away = lambda v: v - left * (np.vdot(right, v) / np.vdot(right, left))
    total = np.zeros_like(x)
    goal = np.linalg.norm(x)
    for _ in range(50):
        rest = x - (apply(total) - value * total)
        rest = away(rest)
        size = np.linalg.norm(rest)
        if size <= tol * goal or goal == 0:
            break
        most = min(space, x.size)
        basis, h = np.zeros((most + 1, x.size), complex), np.zeros((most + 1, most), complex)
        basis[0] = rest / size
        for k in range(most):
            v = away(basis[k])
            v = away(apply(v) - value * v)
            for _ in range(2):
                part = basis[: k + 1].conj() @ v
                v = v - part @ basis[: k + 1]
                h[: k + 1, k] += part
            h[k + 1, k] = np.linalg.norm(v)
            if h[k + 1, k] <= 1e-14 * np.linalg.norm(h[: k + 1, k]):
                break
            basis[k + 1] = v / h[k + 1, k]
        best = np.linalg.lstsq(h[: k + 2, : k + 1], np.eye(k + 2, 1)[:, 0] * size, rcond=None)[0]
        total = away(total + best @ basis[: k + 1])
    return total


def _cycle_solve(backward: list, value: complex, vectors: list[np.ndarray], cotangents: list[np.ndarray]) -> list[np.ndarray]:
    """x of every slot of a cycle: sum over the cycle of conj(x[k + 1]) (steps[k] - value shift) = conj(cotangent)."""
    shape = vectors[0].shape
    n, size = len(vectors), vectors[0].size

    def adjoint(flat: np.ndarray) -> np.ndarray:
        y = flat.reshape(n, *shape)
        return np.concatenate([backward[k](y[(k + 1) % n]).ravel() for k in range(n)])

    f = np.concatenate([v.ravel() for v in vectors])
    # the adjoint's leading vector, one slot's from around the cycle and the others from it
    around = lambda y: _through(backward[::-1], y)
    first = dense.dominant(around, vectors[0].conj())[1]
    slots = [first]
    for k in range(n - 1, 0, -1):
        slots.append(backward[k](slots[-1]) / np.conj(value))
    g = np.concatenate([slots[0].ravel(), *(s.ravel() for s in slots[:0:-1])])
    d = np.concatenate([c.ravel() for c in cotangents])
    d = d - f * (np.vdot(f, d) / np.vdot(f, f))
    # in the adjoint's range: no part along its own leading vector
    solved = complement_solve(adjoint, np.conj(value), d, g, f)
    return list(solved.reshape(n, size).reshape(n, *shape))


def _through(steps: list, x: np.ndarray) -> np.ndarray:
    for step in steps:
        x = step(x)
    return x


def _left_cotangents(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    t = read(rows)
    problem, i = int(key[0]), int(key[1])
    n = sum(name == "M" for name, _, _ in t)
    parts = [(t["AL", i, j], t["M", i, j], t["DL", i, j]) for j in range(n)]
    # the adjoint of a step to the right is the conjugate step to the left
    backward = [lambda y, p=p: dense.right_step(y, *(x.conj() for x in p)) for p in parts]
    vectors = [t["FL", i, j] for j in range(n)]
    cotangents = [t["DF", i, j] if ("DF", i, j) in t else np.zeros_like(vectors[0]) for j in range(n)]
    x = _cycle_solve(backward, complex(t["VL", i, 0]), vectors, cotangents)
    return write(problem, {("X", i, j): x[j] for j in range(n)})


def left_cotangents(upper: DataFrame, lower: DataFrame, env: DataFrame, rows: int, mirrored: bool = False) -> DataFrame:
    """``X`` of each cell from cotangents ``DF`` of ``FL``.

    ``env`` has ``FL``, ``VL`` and ``DF``. The cotangent of a factor at a cell
    is the derivative (``d_upper``, ``d_bulk``, ``d_lower`` of ``maps``) with ``FL`` there and, as
    right environment, the conjugate ``X`` of the next column.
    """
    ship(upper.sparkSession)
    parts = _only(upper, "AL", "M").unionByName(moved(lower, "AL", "DL", i=_below(rows, mirrored))).unionByName(_only(env, "FL", "VL", "DF"))
    return parts.groupBy("problem", "i").applyInPandas(_left_cotangents, SCHEMA)


def _right_cotangents(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    t = read(rows)
    problem, i = int(key[0]), int(key[1])
    n = sum(name == "M" for name, _, _ in t)
    order = [n - 1 - k for k in range(n)]
    parts = [(t["AR", i, j], t["M", i, j], t["DR", i, j]) for j in order]
    backward = [lambda y, p=p: dense.left_step(y, *(x.conj() for x in p)) for p in parts]
    vectors = [t["FR", i, j] for j in order]
    cotangents = [t["DF", i, j] if ("DF", i, j) in t else np.zeros_like(vectors[0]) for j in order]
    x = _cycle_solve(backward, complex(t["VR", i, 0]), vectors, cotangents)
    return write(problem, {("X", i, j): x[k] for k, j in enumerate(order)})


def right_cotangents(upper: DataFrame, lower: DataFrame, env: DataFrame, rows: int, mirrored: bool = False) -> DataFrame:
    """The same for ``FR``: ``X`` of the column before stands for the left environment."""
    ship(upper.sparkSession)
    parts = _only(upper, "AR", "M").unionByName(moved(lower, "AR", "DR", i=_below(rows, mirrored))).unionByName(_only(env, "FR", "VR", "DF"))
    return parts.groupBy("problem", "i").applyInPandas(_right_cotangents, SCHEMA)


def _centre_back(y: np.ndarray, left: np.ndarray, bulk: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = np.tensordot(left, y, (2, 0))  # a d g h
    x = np.tensordot(x, bulk, ([1, 2], [0, 1]))  # a h e b
    return np.tensordot(x, right, ([2, 1], [1, 2]))


def _centre_cotangents(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    t = read(rows)
    problem, j = int(key[0]), int(key[1])
    n = sum(name == "M" for name, _, _ in t)
    parts = [(t["FL", i, j], t["M", i, j], t["FR", i, j]) for i in range(n)]
    backward = [lambda y, p=p: _centre_back(y, *(x.conj() for x in p)) for p in parts]
    vectors = [t["AC", i, j] for i in range(n)]
    cotangents = [t["DF", i, j] if ("DF", i, j) in t else np.zeros_like(vectors[0]) for i in range(n)]
    x = _cycle_solve(backward, complex(t["VA", 0, j]), vectors, cotangents)
    return write(problem, {("X", i, j): x[i] for i in range(n)})


def centre_cotangents(cells: DataFrame) -> DataFrame:
    """The same for ``AC``, by column: ``X`` of the next row stands for the lower state."""
    ship(cells.sparkSession)
    return _only(cells, "FL", "FR", "M", "AC", "VA", "DF").groupBy("problem", "j").applyInPandas(_centre_cotangents, SCHEMA)


def _bond_cotangents(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    t = read(rows)
    problem, j = int(key[0]), int(key[1])
    n = sum(name == "C" for name, _, _ in t)
    parts = [(t["FN", i, j], t["FR", i, j]) for i in range(n)]
    backward = [lambda y, p=p: np.tensordot(np.tensordot(p[0].conj(), y, (2, 0)), p[1].conj(), ([1, 2], [1, 2])) for p in parts]
    vectors = [t["C", i, j] for i in range(n)]
    cotangents = [t["DF", i, j] if ("DF", i, j) in t else np.zeros_like(vectors[0]) for i in range(n)]
    x = _cycle_solve(backward, complex(t["VC", 0, j]), vectors, cotangents)
    return write(problem, {("X", i, j): x[i] for i in range(n)})


def bond_cotangents(cells: DataFrame, columns: int) -> DataFrame:
    """The same for ``C``."""
    ship(cells.sparkSession)
    parts = _only(cells, "FR", "C", "VC", "DF").unionByName(_next_left(cells, columns))
    return parts.groupBy("problem", "j").applyInPandas(_bond_cotangents, SCHEMA)


def qr_pullback(q: np.ndarray, r: np.ndarray, dq: np.ndarray, dr: np.ndarray) -> np.ndarray:
    """Cotangent of a matrix of full column rank from those of its positive QR factors."""
    m = r @ dr.conj().T - dq.conj().T @ q
    half = np.tril(m, -1) + np.diag(np.diag(m).real) / 2
    return np.linalg.solve(r, (dq + q @ (half + half.conj().T)).conj().T).conj().T


def lq_pullback(l: np.ndarray, q: np.ndarray, dl: np.ndarray, dq: np.ndarray) -> np.ndarray:
    """The same for the LQ factors, as the QR of the conjugate transpose."""
    return qr_pullback(q.conj().T, l.conj().T, dq.conj().T, dl.conj().T).conj().T


def _factor_cotangents(left: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        t = read(rows)
        problem, i, j = map(int, key)
        at = lambda k: t[k, i, j]
        a = at("A")
        if left:
            q, r = dense.qr_positive(a)
            return write(problem, {("DA", i, j): qr_pullback(q, r, at("DQ"), at("DR"))})
        q, r = dense.qr_positive(a.conj().T)
        return write(problem, {("DA", i, j): lq_pullback(r.conj().T, q.conj().T, at("DL"), at("DQ"))})

    return run


def factor_cotangents(cells: DataFrame, left: bool = True) -> DataFrame:
    """``DA`` of each cell's matrix ``A`` from ``DQ`` and ``DR`` of its QR (``DL`` of its LQ) factors."""
    ship(cells.sparkSession)
    return cells.where(F.col("name").isin("A", "DQ", "DR", "DL")).groupBy("problem", "i", "j").applyInPandas(_factor_cotangents(left), SCHEMA)


def reshaped(cells: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    """Packed cells with another shape of the same size."""
    return cells.withColumn("shape", F.array(*(F.lit(n) for n in shape)))


def _factors(left: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        (a,) = read(rows).values()
        problem, i, j = map(int, key)
        if left:
            q, r = dense.qr_positive(a)
            return write(problem, {("Q", i, j): q, ("R", i, j): r})
        q, r = dense.qr_positive(a.conj().T)
        return write(problem, {("Q", i, j): q.conj().T, ("L", i, j): r.conj().T})

    return run


def factors(cells: DataFrame, left: bool = True) -> DataFrame:
    """``Q`` and ``R`` of each cell's matrix ``A`` (for ``left=False`` ``L`` and ``Q``), diagonals positive."""
    ship(cells.sparkSession)
    return _only(cells, "A").groupBy("problem", "i", "j").applyInPandas(_factors(left), SCHEMA)


def root_derivative(root: np.ndarray, change: np.ndarray) -> np.ndarray:
    """dS with dS S + S dS = ``change``, for a Hermitian positive root S: solved in S's eigenbasis, where it is a quotient of each entry."""
    values, vectors = np.linalg.eigh((root + root.conj().T) / 2)
    inner = vectors.conj().T @ change @ vectors
    return vectors @ (inner / (values[:, None] + values[None, :])) @ vectors.conj().T


def _roots(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    t = read(rows)
    problem, i, j = map(int, key)
    a = t["A", i, j]
    values, vectors = np.linalg.eigh((a + a.conj().T) / 2)
    root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.conj().T
    out = {("S", i, j): root}
    if ("DA", i, j) in t:
        out["DS", i, j] = root_derivative(root, t["DA", i, j])
    if ("GS", i, j) in t:  # the same equation gives the cotangent, as it is its own adjoint
        out["GA", i, j] = root_derivative(root, t["GS", i, j])
    return write(problem, out)


def matrix_roots(cells: DataFrame) -> DataFrame:
    """Of each cell's Hermitian positive matrix ``A`` the root ``S``; with a change ``DA`` the root's change ``DS``, with a cotangent ``GS`` of the root that of ``A``, ``GA``.

    The changes needn't commute with the matrix.
    """
    ship(cells.sparkSession)
    return _only(cells, "A", "DA", "GS").groupBy("problem", "i", "j").applyInPandas(_roots, SCHEMA)
