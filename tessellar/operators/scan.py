"""An ordered fold over columns as a scan: the density map carried along a row of cells.

A column's map takes the density matrix of its left edge to that of its right one.
Carrying it column by column is a loop with one step a column; composing maps is
associative, so all prefixes follow from a number of self-joins that is the
logarithm of the number of columns, every row and network at once.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import cut
from .contract import contract, pair
from .tensor import Tensor


def transfer_maps(state: Tensor) -> Tensor:
    """Of each cell the map of ``rho`` (``d, c``) to A' rho A (``a, b``)."""
    left, _, right = state.index
    up = state.rename("c", "s", "b")
    return pair(up, state.conj().rename("d", "s", "a"), ("d", "c", "a", "b"))


def prefixes(maps: Tensor, columns: int) -> Tensor:
    """Of each column the composition of the maps of all columns up to it."""
    out = maps._with(cut(maps.df))
    step = 1
    while step < columns:
        # the prefix that ends ``step`` columns before, moved to where it is composed
        before = out._with(out.df.where(F.col("j") < columns - step).withColumn("j", F.col("j") + step)).rename("d", "c", "x", "y")
        joined = contract((before, out._with(out.df.where(F.col("j") >= step)).rename("x", "y", "a", "b")), ("d", "c", "a", "b"))
        first = out.df.where(F.col("j") < step).select(*out.keys, "re", "im")
        out = out._with(cut(first.unionByName(joined.df.select(*out.keys, "re", "im"))))
        step *= 2
    return out


def density_fold(rho: Tensor, state: Tensor, columns: int) -> Tensor:
    """``rho`` of every column from that of column 0, carried through all columns in their order.

    Column j + 1 gets what column j's map makes of the new value at j; what the
    last one gives goes to column 0.
    """
    first = rho._with(rho.df.where(F.col("j") == 0).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))).rename("d", "c")
    return contract((first, prefixes(transfer_maps(state), columns)), "ab").shift("j", 1, columns)
