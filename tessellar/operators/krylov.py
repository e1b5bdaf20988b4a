"""Eigenvectors and linear solves whose vectors are tables.

For maps too large for a task. A vector is a tensor, one for each key (a network's
row or column); a map is any function from such vectors to such vectors, made of
joins and sums. The vectors of a Krylov space are one table with a column ``k``;
inner products with all of them are a join and a sum, and so is a combination of
them. What a grouped map sees are the small projected matrices, one for each key;
the driver sees the worst residual.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dense
from ..functions.lineage import cut
from ..functions.ship import ship
from .tensor import Tensor

Map = Callable[[Tensor], Tensor]


def _kept(t: Tensor) -> Tensor:
    return t._with(cut(t.df.select(*t.keys, "re", "im")))


class Basis:
    """Vectors of each key, numbered by ``k``: orthonormal where they come from ``extend``."""

    def __init__(self, like: Tensor, by: tuple[str, ...]):
        self.like, self.by = like, by
        self.parts: list[DataFrame] = []

    def append(self, x: Tensor) -> None:
        self.parts.append(x.df.select(F.lit(len(self.parts)).alias("k"), *self.like.keys, "re", "im"))

    def last(self) -> Tensor:
        return self.like._with(self.parts[-1].drop("k"))

    def table(self) -> DataFrame:
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.unionByName(part)
        return out

    def products(self, x: Tensor) -> DataFrame:
        """``by, k, hr, hi``: the inner product of every vector with ``x``."""
        other = x.df.select(*x.keys, F.col("re").alias("xr"), F.col("im").alias("xi"))
        both = self.table().join(other, list(x.keys))
        hr = F.sum(F.col("re") * F.col("xr") + F.col("im") * F.col("xi"))
        hi = F.sum(F.col("re") * F.col("xi") - F.col("im") * F.col("xr"))
        return both.groupBy(*self.by, "k").agg(hr.alias("hr"), hi.alias("hi"))

    def combined(self, weights: DataFrame) -> Tensor:
        """The sum of the vectors times ``by, k, hr, hi``."""
        both = self.table().join(weights, [*self.by, "k"])
        re = F.sum(F.col("re") * F.col("hr") - F.col("im") * F.col("hi"))
        im = F.sum(F.col("re") * F.col("hi") + F.col("im") * F.col("hr"))
        return self.like._with(both.groupBy(*self.like.keys).agg(re.alias("re"), im.alias("im")))

    def rest(self, x: Tensor) -> tuple[Tensor, DataFrame]:
        """``x`` (kept) less its parts along the vectors, taken off twice, and these parts."""
        total = None
        for _ in range(2):
            h = self.products(x)
            x = _kept(x.add(self.combined(h).scale(-1.0)))
            total = h if total is None else total.unionByName(h)
        return x, total.groupBy(*self.by, "k").agg(F.sum("hr").alias("hr"), F.sum("hi").alias("hi"))


def norms(x: Tensor, by: tuple[str, ...]) -> DataFrame:
    """``by, norm``."""
    return x.df.groupBy(*by).agg(F.sqrt(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("norm"))


def _over(x: Tensor, sizes: DataFrame, by: tuple[str, ...], least: float = 0.0) -> Tensor:
    """``x`` over ``norm``; keys whose norm isn't over ``least`` are gone."""
    rows = x.df.join(sizes.where(F.col("norm") > least), list(by))
    return x._with(rows.select(*x.keys, (F.col("re") / F.col("norm")).alias("re"), (F.col("im") / F.col("norm")).alias("im")))


#: Below this a vector is nothing but rounding: its key's space is closed.
CLOSED = 1e-14


def _space(apply: Map, first: Tensor, by: tuple[str, ...], space: int) -> tuple[Basis, DataFrame]:
    """An orthonormal basis from ``first`` (of norm 1), and the projected map as ``by, k, col, hr, hi`` (a column's last entry is the norm of what was left)."""
    basis = Basis(first, by)
    basis.append(first)
    entries = None
    for col in range(space):
        w = _kept(apply(basis.last()))
        size = norms(w, by).withColumnRenamed("norm", "whole")
        w, h = basis.rest(w)
        left = norms(w, by)
        own = h.select(*by, "k", F.lit(col).alias("col"), "hr", "hi")
        own = own.unionByName(left.select(*by, F.lit(col + 1).alias("k"), F.lit(col).alias("col"), F.col("norm").alias("hr"), F.lit(0.0).alias("hi")))
        entries = own if entries is None else entries.unionByName(own)
        if col + 1 < space:
            # where nothing but rounding is left the key's space is closed: it has no more vectors
            open_ = left.join(size, list(by)).where(F.col("norm") > CLOSED * F.col("whole")).select(*by, "norm")
            following = _kept(_over(w, open_, by))
            if following.df.isEmpty():
                break
            basis.append(following)
    return basis, cut(entries)


def _projected(rows: pd.DataFrame) -> np.ndarray:
    """The (n + 1) x n matrix of one key, n as far as its space goes."""
    n = int(rows["col"].max()) + 1
    h = np.zeros((n + 1, n), complex)
    h[rows["k"], rows["col"]] = rows["hr"] + 1j * rows["hi"]
    for k in range(n):
        # a column whose rest was rounding ends the space
        if abs(h[k + 1, k]) <= CLOSED * np.linalg.norm(h[:, k]):
            return h[: k + 2, : k + 1]
    return h


def _answers(entries: DataFrame, by: tuple[str, ...], solve: Callable[[np.ndarray, pd.DataFrame], list[tuple]]) -> DataFrame:
    """``by, k, hr, hi, vr, vi, residual`` from each key's projected matrix."""
    kinds = dict(entries.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "k int, hr double, hi double, vr double, vi double, residual double"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(solve(_projected(rows), rows), columns=["k", "hr", "hi", "vr", "vi", "residual"])
        for c in by:
            out.insert(0, c, rows[c].iloc[0])
        return out[[*by, "k", "hr", "hi", "vr", "vi", "residual"]].astype({"k": "int32"})

    return cut(entries.groupBy(*by).applyInPandas(run, schema))


def _ritz(h: np.ndarray, _: pd.DataFrame) -> list[tuple]:
    n = h.shape[1]
    values, vectors = np.linalg.eig(h[:n])
    best = dense.leading(values)
    y, v = vectors[:, best] / np.linalg.norm(vectors[:, best]), values[best]
    residual = abs(h[n, n - 1] * y[-1]) / max(abs(v), 1e-300)
    return [(k, y[k].real, y[k].imag, v.real, v.imag, residual) for k in range(n)]


def dominant(apply: Map, guess: Tensor, by: tuple[str, ...] = ("problem",), tol: float = 1e-12, space: int = 12, restarts: int = 20) -> tuple[DataFrame, Tensor]:
    """``by, vr, vi`` and vectors of norm 1: of each key the eigenpair of largest modulus, by restarted Arnoldi.

    A map mustn't mix keys. A guess of zero has no row in the result. The
    iteration ends when the worst key's residual, over its value, is ``tol``.
    """
    ship(guess.df.sparkSession)
    x = _kept(_over(guess, norms(guess, by), by))
    values = None
    for _ in range(restarts):
        basis, entries = _space(apply, x, by, space)
        found = _answers(entries, by, _ritz)
        x = basis.combined(found)
        x = _kept(_over(x, norms(x, by), by))
        values = found.where("k = 0").select(*by, "vr", "vi", "residual")
        worst = values.agg(F.max("residual").alias("worst")).first().worst
        if worst is None or worst <= tol:
            break
    return values.select(*by, "vr", "vi"), x


def _least_squares(h: np.ndarray, rows: pd.DataFrame) -> list[tuple]:
    goal = np.zeros(len(h), complex)
    goal[0] = rows["goal"].iloc[0]
    y = np.linalg.lstsq(h, goal, rcond=None)[0]
    return [(k, y[k].real, y[k].imag, 0.0, 0.0, float(np.linalg.norm(goal - h @ y))) for k in range(h.shape[1])]


def away(x: Tensor, along: Tensor, dual: Tensor, by: tuple[str, ...]) -> Tensor:
    """``x`` less ``along`` times <dual, x> / <dual, along>."""
    one = Basis(dual, by)
    one.append(dual)
    p, q = one.products(x), one.products(along).select(*by, F.col("hr").alias("qr"), F.col("hi").alias("qi"))
    size = F.col("qr") * F.col("qr") + F.col("qi") * F.col("qi")
    part = p.join(q, list(by)).select(*by, F.lit(0).alias("k"), (F.lit(0.0) - F.try_divide(F.col("hr") * F.col("qr") + F.col("hi") * F.col("qi"), size)).alias("hr"), F.try_divide(F.col("hr") * F.col("qi") - F.col("hi") * F.col("qr"), size).alias("hi"))
    two = Basis(along, by)
    two.append(along)
    return x.add(two.combined(cut(part)))


def solve(apply: Map, goal: Tensor, by: tuple[str, ...] = ("problem",), along: Tensor | None = None, dual: Tensor | None = None, tol: float = 1e-12, space: int = 12, restarts: int = 20) -> tuple[Tensor, DataFrame]:
    """x with apply(x) = goal, and ``by, residual`` (its norm over the goal's), by restarted GMRES.

    With ``along`` and ``dual``, the vectors that the map and its adjoint make
    nothing of, everything is kept in the complement: x has no part along
    ``along``, and the goal's is taken off.
    """
    ship(goal.df.sparkSession)
    inside = (lambda t: _kept(away(t, along, dual, by))) if along is not None else _kept
    goal = inside(goal)
    aim = cut(norms(goal, by).withColumnRenamed("norm", "aim"))
    x, rest = None, goal
    for _ in range(restarts):
        size = cut(norms(rest, by))
        open_ = size.join(aim, list(by)).where(F.col("norm") > tol * F.col("aim"))
        first = _kept(_over(rest, cut(open_.select(*by, "norm")), by))
        if first.df.isEmpty():
            break
        basis, entries = _space(lambda t: inside(apply(inside(t))), first, by, space)
        entries = entries.join(size.withColumnRenamed("norm", "goal"), list(by))
        step = inside(basis.combined(_answers(entries, by, _least_squares)))
        x = step if x is None else _kept(x.add(step))
        rest = inside(goal.add(apply(x).rename(*goal.index).scale(-1.0)))
    if x is None:
        x = goal.scale(0.0)
    left = norms(rest, by).join(aim, list(by))
    return x, left.select(*by, F.when(F.col("aim") == 0, 0.0).otherwise(F.try_divide("norm", "aim")).alias("residual"))


def _leading_block(count: int):
    def solve(h: np.ndarray) -> list[tuple]:
        values, vectors = np.linalg.eig(h)
        order = sorted(range(len(values)), key=lambda k: -abs(values[k]))
        # of moduli that agree to rounding the largest real part is first, of those the largest imaginary one
        out: list[int] = []
        while order and len(out) < count:
            near = [k for k in order if abs(values[order[0]]) - abs(values[k]) <= 1e-9 * abs(values[order[0]])]
            out += sorted(near, key=lambda k: (-round(values[k].real / max(abs(values[k]), 1e-300), 7), -values[k].imag))
            order = [k for k in order if k not in near]
        return [(place, k, vectors[k, c].real, vectors[k, c].imag, values[c].real, values[c].imag) for place, c in enumerate(out[:count]) for k in range(len(h))]

    return solve


def _block_products(one: Tensor, two: Tensor, by: tuple[str, ...]) -> DataFrame:
    """``by, k, col, hr, hi``: inner products of every vector of a block with every one of another."""
    keys = [c for c in one.keys if c != "k"]
    other = two.df.select(*keys, F.col("k").alias("col"), F.col("re").alias("xr"), F.col("im").alias("xi"))
    hr = F.sum(F.col("re") * F.col("xr") + F.col("im") * F.col("xi")).alias("hr")
    hi = F.sum(F.col("re") * F.col("xi") - F.col("im") * F.col("xr")).alias("hi")
    return one.df.join(other, keys).groupBy(*by, "k", "col").agg(hr, hi)


def _block_combined(block: Tensor, weights: DataFrame) -> Tensor:
    """The vectors ``col`` made of those of a block times ``by, k, col, hr, hi``."""
    keys = [c for c in block.keys if c != "k"]
    both = block.df.join(weights, [c for c in weights.columns if c not in ("col", "hr", "hi")])
    re = F.sum(F.col("re") * F.col("hr") - F.col("im") * F.col("hi")).alias("re")
    im = F.sum(F.col("re") * F.col("hi") + F.col("im") * F.col("hr")).alias("im")
    return block._with(both.groupBy(*keys, "col").agg(re, im).withColumnRenamed("col", "k").select(*block.keys, "re", "im"))


def leading(apply: Map, guesses: list[Tensor], count: int, by: tuple[str, ...] = ("problem",), tol: float = 1e-10, rounds: int = 60, inner: int = 1) -> tuple[DataFrame, Tensor]:
    """The ``count`` eigenvalues of largest modulus as ``by, k, vr, vi``, and their vectors (``k`` among the batch), by subspace iteration.

    A block of as many vectors as there are guesses (some more than ``count``),
    one tensor with ``k`` among its batch columns, is mapped and made
    orthonormal again, round by round; Ritz values are those of the map projected
    on it. Several eigenvalues of one modulus, which leave a single vector turning
    for ever, are found together: number 0 is that of largest real part
    among them. Ends when no Ritz value moves by more than ``tol`` of the
    largest. ``inner`` maps are done between two times of making the block
    orthonormal. ``apply`` must take blocks, as contractions do.
    """
    ship(guesses[0].df.sparkSession)
    like = guesses[0]
    df = like.df.select(*like.keys, F.lit(0).alias("k"), "re", "im")
    for k, x in enumerate(guesses[1:], 1):
        df = df.unionByName(x.df.select(*like.keys, F.lit(k).alias("k"), "re", "im"))
    block = Tensor(df, like.index, like.dims, (*like.batch, "k"))
    kinds = dict(like.df.dtypes)
    named = ", ".join(f"{c} {kinds[c]}" for c in by)

    def grouped(entries: DataFrame, of: Callable[[np.ndarray], list[tuple]], columns: list[str]) -> DataFrame:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            n = int(rows[["k", "col"]].to_numpy().max()) + 1
            h = np.zeros((n, n), complex)
            h[rows["k"], rows["col"]] = rows["hr"] + 1j * rows["hi"]
            out = pd.DataFrame(of(h), columns=columns)
            for c in by:
                out[c] = rows[c].iloc[0]
            return out[[*by, *columns]].astype({"k": "int32", "col": "int32"})

        return entries.groupBy(*by).applyInPandas(run, f"{named}, " + ", ".join(f"{c} {'int' if c in ('k', 'col') else 'double'}" for c in columns))

    def inverse(g: np.ndarray) -> list[tuple]:
        # a block that has lost a dimension keeps those that it has
        values, vectors = np.linalg.eigh((g + g.conj().T) / 2)
        good = values > 1e-26 * values[-1]
        t = vectors[:, good] / np.sqrt(values[good])
        return [(k, c, t[k, c].real, t[k, c].imag) for k, c in np.ndindex(*t.shape)]

    def orthonormal(x: Tensor) -> Tensor:
        for _ in range(2):
            x = _kept(_block_combined(x, grouped(_block_products(x, x, by), inverse, ["k", "col", "hr", "hi"])))
        return x

    block, before = orthonormal(_kept(block)), None
    for _ in range(rounds):
        mapped = _kept(apply(block).rename(*block.index))
        found = cut(grouped(_block_products(block, mapped, by), _leading_block(count), ["col", "k", "hr", "hi", "vr", "vi"]))
        values = found.where("k = 0").select(*by, "col", "vr", "vi")
        if before is not None:
            old = before.select(*by, "col", F.col("vr").alias("or"), F.col("vi").alias("oi"))
            moved = values.join(old, [*by, "col"]).agg(F.max(F.hypot(F.col("vr") - F.col("or"), F.col("vi") - F.col("oi"))).alias("d"), F.max(F.hypot("vr", "vi")).alias("m")).first()
            if moved.d is None or moved.d <= tol * moved.m:
                break
        before, ended = values, block
        for _ in range(inner - 1):
            mapped = _kept(apply(mapped).rename(*block.index))
        block = orthonormal(mapped)
    else:
        block = ended  # the last Ritz vectors are of the block before
    vectors = _block_combined(block, found.select(*by, "k", "col", "hr", "hi"))
    return values.withColumnRenamed("col", "k"), _kept(vectors)
