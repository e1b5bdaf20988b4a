"""QR and LQ factors with a positive diagonal, by way of the Gram matrix.

R is the Cholesky factor of A'A and Q = A R^-1; both are unique at full column
rank. The Gram matrix is a self-join on the row index and a sum, so the tall
side may be of any length; only n x n matrices reach a Python worker. Twice is
as accurate as Householder's QR unless the condition number nears 1e8.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.ship import ship
from .contract import contract
from .tensor import Tensor


def gram(a: Tensor, column: str, other: str) -> Tensor:
    """A'A of each cell, ``column`` conjugated."""
    renamed = a.rename(*(other if k == column else k for k in a.index))
    return contract((a.conj(), renamed), (column, other))


def gram_r2(a: Tensor, column: str) -> DataFrame:
    """R of a matrix with two columns, in closed form: one aggregation, no join.

    Columns: the batch, ``r11, r12_re, r12_im, r22``.
    """
    rows = [k for k in a.index if k != column]
    part = lambda k, c: F.max(F.when(F.col(column) == k, F.col(c)))
    wide = a.df.groupBy(*rows, *a.batch).agg(*(F.coalesce(part(k, c), F.lit(0.0)).alias(f"{c}{k}") for k in (0, 1) for c in ("re", "im")))
    g = wide.groupBy(*a.batch).agg(
        F.sum(F.col("re0") * F.col("re0") + F.col("im0") * F.col("im0")).alias("g11"),
        F.sum(F.col("re0") * F.col("re1") + F.col("im0") * F.col("im1")).alias("g12r"),
        F.sum(F.col("re0") * F.col("im1") - F.col("im0") * F.col("re1")).alias("g12i"),
        F.sum(F.col("re1") * F.col("re1") + F.col("im1") * F.col("im1")).alias("g22"),
    )
    r11 = F.sqrt("g11")
    g = g.select(*a.batch, r11.alias("r11"), F.try_divide("g12r", r11).alias("r12_re"), F.try_divide("g12i", r11).alias("r12_im"), "g22")
    rest = F.col("g22") - (F.col("r12_re") * F.col("r12_re") + F.col("r12_im") * F.col("r12_im"))
    return g.withColumn("r22", F.sqrt(F.greatest(rest, F.lit(0.0)))).drop("g22")


def _upper(inverse: bool, column: str, other: str, n: int, batch: tuple[str, ...]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((n, n), complex)
        g[rows[column], rows[other]] = rows["re"] + 1j * rows["im"]
        r = np.linalg.cholesky((g + g.conj().T) / 2).conj().T
        r = np.linalg.inv(r) if inverse else r
        x, y = np.nonzero(np.triu(np.ones((n, n))))
        out = pd.DataFrame({column: x, other: y, "re": r[x, y].real, "im": r[x, y].imag})
        for k in batch:
            out[k] = rows[k].iloc[0]
        return out[[column, other, *batch, "re", "im"]].astype({column: "int32", other: "int32"})

    return run


def qrpos(a: Tensor, column: str, other: str = "z") -> tuple[Tensor, Tensor]:
    """Q (indices of ``a``) and R (``column, other``), R's diagonal positive; twice over for accuracy."""
    ship(a.df.sparkSession)
    n = a.dims[column]
    schema = ", ".join([f"{column} int, {other} int", *(f"{k} int" for k in a.batch), "re double, im double"])

    def once(x: Tensor) -> tuple[Tensor, Tensor]:
        g = gram(x, column, other)
        g = g._with(cut(g.df))
        dims = {column: n, other: n}
        factor = lambda inverse: Tensor(g.df.groupBy(*x.batch).applyInPandas(_upper(inverse, column, other, n, x.batch), schema), (column, other), dims, x.batch)
        q = contract((x, factor(True)), tuple(other if k == column else k for k in x.index)).rename(*x.index)
        return q, factor(False)

    q, r = once(a._with(cut(a.df)))
    q, again = once(q._with(cut(q.df)))
    return q, contract((again.rename(column, "_k"), r.rename("_k", other)), (column, other))


def lqpos(a: Tensor, row: str, other: str = "z") -> tuple[Tensor, Tensor]:
    """L and Q: the conjugate transposes of the factors of the conjugate transpose."""
    q, r = qrpos(a.conj(), row, other)
    l = r.conj()
    return Tensor(l.df.select(F.col(other).alias(row), F.col(row).alias(other), *l.batch, "re", "im"), (row, other), l.dims, l.batch), q.conj()
