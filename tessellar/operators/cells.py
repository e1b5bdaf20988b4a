"""Tensors packed by cell: one row for each tensor of a cell of a problem.

A problem is one network of a sweep. Grouped maps work on these rows; their
keys are a problem with a row, a column or a cell of it, so a sweep spreads
over the cluster and a group never exceeds a few tensors of one network.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tensor import Tensor

KEYS = ("problem", "i", "j")
SCHEMA = "problem bigint, name string, i int, j int, shape array<int>, re array<double>, im array<double>"


def pack(tensor: Tensor, name: str) -> DataFrame:
    """Entries in row-major order; missing ones are 0."""
    dims = [tensor.dims[k] for k in tensor.index]
    total = int(np.prod(dims))
    place = F.lit(0)
    for k, n in zip(tensor.index, dims, strict=True):
        place = place * n + F.col(k)
    own = tensor.df.select(*KEYS, place.alias("p"), "re", "im")
    zero = tensor.df.select(*KEYS).distinct().select(*KEYS, F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("p"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    entries = own.unionByName(zero).groupBy(*KEYS, "p").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    # a tensor of one cell, whose size is known
    cells = entries.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("p", "re", "im"))).alias("x"))
    return cells.select(F.col("problem").cast("long").alias("problem"), F.lit(name).alias("name"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.array(*(F.lit(n) for n in dims)).alias("shape"), F.col("x.re").alias("re"), F.col("x.im").alias("im"))


def unpack(cells: DataFrame, name: str, index: str | tuple[str, ...], dims: tuple[int, ...]) -> Tensor:
    """The tensor ``name`` of every cell as entries."""
    rows = cells.where(F.col("name") == name).select(*KEYS, F.posexplode(F.arrays_zip("re", "im")).alias("p", "x"))
    cols, below = [], 1
    for k, n in reversed(list(zip(index, dims, strict=True))):
        cols.append(F.pmod(F.floor(F.col("p") / below), F.lit(n)).cast("int").alias(k))
        below *= n
    return Tensor(rows.select(*reversed(cols), *KEYS, "x.re", "x.im"), tuple(index), dict(zip(index, dims, strict=True)), KEYS)


def moved(cells: DataFrame, name: str, new: str, i=None, j=None) -> DataFrame:
    """Tensors ``name`` under another name, at another row or column."""
    i, j = (F.col(k) if x is None else x for k, x in (("i", i), ("j", j)))
    return cells.where(F.col("name") == name).select("problem", F.lit(new).alias("name"), i.cast("int").alias("i"), j.cast("int").alias("j"), "shape", "re", "im")


def read(rows: pd.DataFrame) -> dict[tuple[str, int, int], np.ndarray]:
    fields = (rows[k] for k in ("name", "i", "j", "shape", "re", "im"))
    return {(name, i, j): (np.asarray(re) + 1j * np.asarray(im)).reshape(tuple(shape)) for name, i, j, shape, re, im in zip(*fields, strict=True)}


def write(problem: int, tensors: dict[tuple[str, int, int], np.ndarray | complex]) -> pd.DataFrame:
    rows = [(problem, name, i, j, list(x.shape), x.real.ravel(), x.imag.ravel()) for (name, i, j), x in ((k, np.asarray(x)) for k, x in tensors.items())]
    return pd.DataFrame(rows, columns=["problem", "name", "i", "j", "shape", "re", "im"])
