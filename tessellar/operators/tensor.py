"""Tensors as DataFrames: an integer column for each index, ``re`` and ``im``.

``batch`` names the cell's columns (``i`` row, ``j`` column). A missing row is
an entry of 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tensor:
    df: DataFrame
    index: tuple[str, ...]
    dims: dict[str, int] = field(default_factory=dict)
    batch: tuple[str, ...] = ("i", "j")

    @property
    def keys(self) -> tuple[str, ...]:
        return self.index + self.batch

    def _with(self, df: DataFrame) -> Tensor:
        return Tensor(df, self.index, self.dims, self.batch)

    def conj(self) -> Tensor:
        # 0 - x, so that a zero stays a positive one
        return self._with(self.df.withColumn("im", F.lit(0.0) - F.col("im")))

    def minus_conj(self) -> Tensor:
        return self._with(self.df.withColumn("re", F.lit(0.0) - F.col("re")))

    def rename(self, *names: str) -> Tensor:
        """The same entries under other index names; nothing moves."""
        new = dict(zip(self.index, names, strict=True))
        cols = [F.col(k).alias(new.get(k, k)) for k in self.keys]
        return Tensor(self.df.select(*cols, "re", "im"), tuple(names), {new[k]: n for k, n in self.dims.items() if k in new}, self.batch)

    def shift(self, axis: str, by: int, size: int) -> Tensor:
        """Slot k goes to k + by, cyclically."""
        return self._with(self.df.withColumn(axis, F.pmod(F.col(axis) + F.lit(by), F.lit(size))))

    def mirror(self, axis: str, size: int) -> Tensor:
        return self._with(self.df.withColumn(axis, F.lit(size - 1) - F.col(axis)))

    def flip(self, down: str, up: str, rows: str, size: int) -> Tensor:
        """Seen from below: conjugate, down and up legs exchanged, rows reversed; one projection."""
        new = {down: up, up: down}
        cols = [(F.lit(size - 1) - F.col(k)).alias(k) if k == rows else F.col(new.get(k, k)).alias(k) for k in self.keys]
        return self._with(self.df.select(*cols, "re", (F.lit(0.0) - F.col("im")).alias("im")))

    def fix(self, axis: str, value: int) -> Tensor:
        """A slice; the filter goes down to the aggregation's input."""
        return self._with(self.df.where(F.col(axis) == value))

    def scale(self, re: float, im: float = 0.0) -> Tensor:
        a, b = F.col("re"), F.col("im")
        return self._with(self.df.select(*self.keys, (a * re - b * im).alias("re"), (a * im + b * re).alias("im")))

    def add(self, other: Tensor) -> Tensor:
        both = self.df.select(*self.keys, "re", "im").unionByName(other.df.select(*self.keys, "re", "im"))
        return self._with(both.groupBy(*self.keys).agg(F.sum("re").alias("re"), F.sum("im").alias("im")))

    def phase(self) -> Tensor:
        """x / |x| of each entry, 1 at zero."""
        size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
        return self._with(self.df.select(*self.keys, F.when(size == 0, 1.0).otherwise(F.try_divide("re", size)).alias("re"), F.when(size == 0, 0.0).otherwise(F.try_divide("im", size)).alias("im")))

    def norms(self) -> DataFrame:
        """The Frobenius norm of each cell."""
        return self.df.groupBy(*self.batch).agg(F.sqrt(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("norm"))

    def normalized(self, by: tuple[str, ...] | None = None) -> Tensor:
        """Divided by the norm of each cell, or of the whole for ``by=()``.

        The norms are one row a cell: aggregated first, then joined, so that
        no window sorts the entries.
        """
        by = self.batch if by is None else by
        squares = F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
        norm = self.df.groupBy(*by).agg(F.sqrt(squares).alias("norm"))
        rows = self.df.join(norm, list(by)) if by else self.df.join(F.broadcast(norm))
        return self._with(rows.select(*self.keys, F.try_divide("re", "norm").alias("re"), F.try_divide("im", "norm").alias("im")))

    def trace(self) -> DataFrame:
        a, b = self.index
        return self.df.where(F.col(a) == F.col(b)).groupBy(*self.batch).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))

    def hermitized(self) -> Tensor:
        """(rho + rho') / trace of each cell."""
        a, b = self.index
        turned = self.conj().df.select(F.col(b).alias(a), F.col(a).alias(b), *self.batch, "re", "im")
        both = self.add(self._with(turned))
        diagonal = F.sum(F.when(F.col(a) == F.col(b), F.col("re")).otherwise(0.0)).over(Window.partitionBy(*self.batch))
        return self._with(both.df.withColumn("t", diagonal).select(*self.keys, F.try_divide("re", "t").alias("re"), F.try_divide("im", "t").alias("im")))


def identity(cells: DataFrame, size: int, index: tuple[str, str] = ("a", "b"), batch: tuple[str, ...] = ("i", "j")) -> Tensor:
    """The identity matrix in every cell of a table of cells."""
    a, b = index
    df = cells.select(*batch).distinct().withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn(b, F.col(a))
    return Tensor(df.select(*index, *batch, F.lit(1.0).alias("re"), F.lit(0.0).alias("im")), index, {a: size, b: size}, batch)


def random_like(cells: DataFrame, dims: dict[str, int], seed: int, batch: tuple[str, ...] = ("i", "j")) -> Tensor:
    """Entries in (0, 1) from a hash of their indices: the same in every run."""
    df = cells.select(*batch).distinct()
    for k, n in dims.items():
        df = df.withColumn(k, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    unit = lambda part: F.conv(F.substring(F.md5(F.concat_ws(",", F.lit(seed), F.lit(part), *dims, *batch)), 1, 8), 16, 10).cast("double") / 4294967296.0
    return Tensor(df.select(*dims, *batch, unit("re").alias("re"), unit("im").alias("im")), tuple(dims), dict(dims), batch)
