"""Factors of tall matrices: QR by a tree of small factors, singular values by Jacobi rotations, triangular solves by joins.

A matrix is a tensor: one index numbers its columns, the others together its rows,
the batch its cells. No task holds more than some rows of one cell and a few n x n
factors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dense
from ..functions.lineage import cut
from ..functions.ship import ship
from .contract import contract
from .tensor import Tensor

#: Rows of one cell that are stacked at a time, and factors merged by one group.
ROWS, FAN = 2048, 32


def _wide(a: Tensor, column: str) -> DataFrame:
    """A row of the matrix to a row: the batch, ``row`` (a struct of the other indices), ``re``, ``im`` as arrays over the columns."""
    rest = [k for k in a.index if k != column]
    at = lambda k, c: F.coalesce(F.sum(F.when(F.col(column) == k, F.col(c))), F.lit(0.0))
    arrays = [F.array(*(at(k, c) for k in range(a.dims[column]))).alias(c) for c in ("re", "im")]
    return a.df.groupBy(*rest, *a.batch).agg(*arrays)


def _schema(df: DataFrame, batch: tuple[str, ...], more: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"{k} {kinds[k]}" for k in batch), more])


def _matrices(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["re"].to_list()) + 1j * np.stack(frame["im"].to_list())


def _as_rows(r: np.ndarray, batch: tuple[str, ...], key: tuple, part: int) -> pd.DataFrame:
    n = len(r)
    out = pd.DataFrame({"part": [part] * n, "z": range(n), "re": list(r.real), "im": list(r.imag)})
    for name, value in zip(batch, key, strict=True):
        out[name] = value
    return out[[*batch, "part", "z", "re", "im"]]


def _small_r(stack: np.ndarray, n: int) -> np.ndarray:
    """R (n x n, diagonal not negative) of stacked rows, fewer than n of them filled up with zeros."""
    if len(stack) < n:
        stack = np.concatenate([stack, np.zeros((n - len(stack), n))])
    return dense.qr_positive(stack)[1]


def tall_r(a: Tensor, column: str) -> DataFrame:
    """R of each cell as ``batch, z, re, im`` (arrays over the columns), its diagonal positive.

    Every task reduces the rows it has of a cell to one factor, as they come;
    the factors are merged FAN at a time, level by level, so that neither a
    cell with most of the rows nor very many partitions meet in one group.
    """
    ship(a.df.sparkSession)
    n, batch = a.dims[column], a.batch
    wide = _wide(a, column)

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        held: dict[tuple, np.ndarray] = {}
        for frame in frames:
            for key, own in frame.groupby(list(batch)):
                x = _matrices(own)
                for k in range(0, len(x), ROWS):
                    old = held.get(key)
                    held[key] = _small_r(x[k : k + ROWS] if old is None else np.concatenate([old, x[k : k + ROWS]]), n)
        for key, r in held.items():
            yield _as_rows(r, batch, key, part)

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["part", "z"])
        return _as_rows(_small_r(_matrices(frame), n), batch, key[:-1], int(key[-1]))

    schema = _schema(a.df, batch, "part int, z int, re array<double>, im array<double>")
    factors = cut(wide.mapInPandas(local, schema))
    while True:
        factors = cut(factors.groupBy(*batch, F.floor(F.col("part") / FAN).cast("int").alias("p")).applyInPandas(merge, schema))
        most = factors.agg(F.max("part").alias("most")).first().most
        if most is None or most == 0:
            return factors.drop("part")


def _times_inverse(a: Tensor, column: str, other: str, r: DataFrame) -> Tensor:
    """A R^-1, a map over rows with their cell's factor beside them; ``other`` in the place of ``column``."""
    n, batch = a.dims[column], a.batch
    rest = [k for k in a.index if k != column]
    flat = r.groupBy(*batch).agg(F.array_sort(F.collect_list(F.struct("z", "re", "im"))).alias("r"))
    rows = _wide(a, column).join(flat, list(batch))
    schema = _schema(a.df, (*rest, *batch), "re array<double>, im array<double>")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = []
            for _, own in frame.groupby(list(batch)):
                f = np.stack([np.asarray(x["re"]) + 1j * np.asarray(x["im"]) for x in own["r"].iloc[0]])
                x = _matrices(own)
                # a column that others span leaves a zero on the diagonal, and no column of Q
                q = x @ (np.linalg.inv(f) if np.abs(np.diag(f)).min() > 0 else np.linalg.pinv(f))
                parts.append(own[[*rest, *batch]].assign(re=list(q.real), im=list(q.imag)))
            if parts:
                yield pd.concat(parts)

    q = rows.mapInPandas(run, schema).select(*rest, *batch, F.posexplode(F.arrays_zip("re", "im")).alias(other, "x"))
    index = tuple(other if k == column else k for k in a.index)
    return Tensor(q.select(*index, *batch, "x.re", "x.im"), index, {k: a.dims.get(k, n) for k in index}, batch)


def tall_qr(a: Tensor, column: str, other: str = "z") -> tuple[Tensor, Tensor]:
    """Q (``other`` in the place of ``column``) and R (``other, column``), R's diagonal positive.

    R comes from a tree of Householder factors, so nothing is squared, and Q
    is A R^-1, made orthonormal by a second round on itself; both are accurate
    up to condition numbers near 1e15. ``other`` mustn't be an index of ``a``.
    """
    a = a._with(cut(a.df))
    n = a.dims[column]

    def tensor(r: DataFrame, row: str, col: str) -> Tensor:
        rows = r.select(F.col("z").alias(row), *a.batch, F.posexplode(F.arrays_zip("re", "im")).alias(col, "x"))
        return Tensor(rows.select(row, col, *a.batch, "x.re", "x.im"), (row, col), {row: n, col: n}, a.batch)

    first = tall_r(a, column)
    q = _times_inverse(a, column, "_q", first)
    q = q._with(cut(q.df))
    again = tall_r(q, "_q")
    r = contract((tensor(again, other, "_q"), tensor(first, "_q", column)), (other, column))
    return _times_inverse(q, "_q", other, again), r._with(r.df.where(F.col(other) <= F.col(column)))


def tall_lq(a: Tensor, row: str, other: str = "z") -> tuple[Tensor, Tensor]:
    """L (``row, other``) and Q: the conjugate transposes of the factors of the conjugate transpose."""
    q, r = tall_qr(a.conj(), row, other)
    l = r.conj()
    return Tensor(l.df.select(row, other, *l.batch, "re", "im"), (row, other), l.dims, l.batch), q.conj()


def _rounds(n: int) -> list[list[tuple[int, int]]]:
    """Every pair of n columns once, in rounds of disjoint pairs: one stands still, the others go round."""
    m = n + n % 2
    ring = list(range(1, m))
    out = []
    for _ in range(m - 1):
        seats = [0, *ring]
        pairs = [(seats[k], seats[m - 1 - k]) for k in range(m // 2)]
        out.append([(min(p), max(p)) for p in pairs if max(p) < n])
        ring = ring[-1:] + ring[:-1]
    return out


def svd(a: Tensor, column: str, tol: float = 1e-14, sweeps: int = 30) -> tuple[Tensor, DataFrame, Tensor]:
    """``U`` (indices of ``a``), ``batch, column, s`` and ``V`` (``_v, column``): a = sum of U s conj(V), s falling.

    One-sided Jacobi: columns are rotated in pairs until all are orthogonal. A
    round rotates disjoint pairs, of all cells at once; what moves is the matrix
    itself, by pair and row. V is what the same rotations make of the identity.
    A column of norm 0 has no row in U.
    """
    rest = [k for k in a.index if k != column]
    batch = list(a.batch)
    n = a.dims[column]
    eye = a.df.select(*batch).distinct().withColumn("_v", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(column, F.col("_v"))
    # V's rows stand below the matrix's: same rotations
    top = a.df.select(*(F.col(k).cast("int").alias(k) for k in rest), F.lit(None).cast("int").alias("_v"), *batch, F.col(column).cast("int").alias(column), "re", "im")
    below = eye.select(*(F.lit(None).cast("int").alias(k) for k in rest), F.col("_v").cast("int").alias("_v"), *batch, F.col(column).cast("int").alias(column), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    x = cut(top.unionByName(below))
    row = F.struct(*rest, "_v")
    for _ in range(sweeps):
        off = 0.0
        for pairs in _rounds(n):
            known = F.create_map(*(F.lit(v) for p, q in pairs for v in (p, p, q, p)))
            partner = F.create_map(*(F.lit(v) for p, q in pairs for v in (p, q, q, p)))
            placed = x.where(F.col(column).isin([k for pair in pairs for k in pair])).withColumn("_p", known[F.col(column)])
            part = lambda c, first: F.coalesce(F.sum(F.when((F.col(column) == F.col("_p")) == first, F.col(c))), F.lit(0.0))
            both = placed.groupBy(*batch, "_p", row.alias("_row")).agg(part("re", True).alias("pr"), part("im", True).alias("pi"), part("re", False).alias("qr"), part("im", False).alias("qi"))
            both = cut(both)
            own = both.where(F.col("_row._v").isNull())
            g = own.groupBy(*batch, "_p").agg(
                F.sum(F.col("pr") * F.col("pr") + F.col("pi") * F.col("pi")).alias("a"),
                F.sum(F.col("qr") * F.col("qr") + F.col("qi") * F.col("qi")).alias("b"),
                F.sum(F.col("pr") * F.col("qr") + F.col("pi") * F.col("qi")).alias("gr"),
                F.sum(F.col("pr") * F.col("qi") - F.col("pi") * F.col("qr")).alias("gi"),
            )
            size = F.hypot("gr", "gi")
            zeta = F.try_divide(F.col("b") - F.col("a"), 2 * size)
            t = F.when(size == 0, 0.0).otherwise(F.when(zeta < 0, -1.0).otherwise(1.0) / (F.abs(zeta) + F.sqrt(1 + zeta * zeta)))
            g = g.select(*batch, "_p", F.try_divide(size, F.sqrt(F.col("a") * F.col("b"))).alias("off"), t.alias("t"), F.when(size == 0, 1.0).otherwise(F.try_divide("gr", size)).alias("ur"), F.when(size == 0, 0.0).otherwise(F.try_divide("gi", size)).alias("ui"))
            g = cut(g.withColumn("c", 1 / F.sqrt(1 + F.col("t") * F.col("t"))).withColumn("s", F.col("c") * F.col("t")))
            worst = g.agg(F.max("off").alias("off")).first().off
            off = max(off, worst or 0.0)
            # q's phase is turned so that the product is real: q u* , then a plane rotation
            turned = both.join(g, [*batch, "_p"], "left").na.fill({"c": 1.0, "s": 0.0, "ur": 1.0, "ui": 0.0})
            qr, qi = F.col("qr") * F.col("ur") + F.col("qi") * F.col("ui"), F.col("qi") * F.col("ur") - F.col("qr") * F.col("ui")
            turned = turned.select(*batch, "_p", "_row", F.explode(F.array(
                F.struct(F.col("_p").alias("col"), (F.col("c") * F.col("pr") - F.col("s") * qr).alias("re"), (F.col("c") * F.col("pi") - F.col("s") * qi).alias("im")),
                F.struct(partner[F.col("_p")].alias("col"), (F.col("s") * F.col("pr") + F.col("c") * qr).alias("re"), (F.col("s") * F.col("pi") + F.col("c") * qi).alias("im")),
            )).alias("x"))
            new = turned.select(*(F.col(f"_row.{k}").alias(k) for k in (*rest, "_v")), *batch, F.col("x.col").alias(column), "x.re", "x.im")
            idle = x.where(~F.col(column).isin([k for pair in pairs for k in pair]))
            x = cut(new.unionByName(idle.select(*new.columns)))
        if off <= tol:
            break
    values = x.where(F.col("_v").isNull()).groupBy(*batch, column).agg(F.sqrt(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("s"))
    order = cut(values.withColumn("_n", F.row_number().over(Window.partitionBy(*batch).orderBy(F.desc("s"), column)) - 1))
    placed = x.join(order, [*batch, column]).drop(column).withColumnRenamed("_n", column)
    u = placed.where("_v is null and s > 0").select(*a.index, *batch, (F.col("re") / F.col("s")).alias("re"), (F.col("im") / F.col("s")).alias("im"))
    v = placed.where("_v is not null").select("_v", column, *batch, "re", "im")
    return a._with(u), order.select(*batch, F.col("_n").alias(column), "s"), Tensor(v, ("_v", column), {"_v": n, column: n}, a.batch)


def back_substituted(r: Tensor, b: Tensor, block: int = 1) -> Tensor:
    """x with R x = b for an upper triangular R (its row's index, its column's), level by level from the last rows up.

    ``b`` has R's row index and any others. A level solves ``block`` rows and
    takes what they give off all rows above, one join and sum.
    """
    row, col = r.index
    n = r.dims[row]
    others = [k for k in b.keys if k != row]
    left = b._with(cut(b.df.select(*b.keys, "re", "im")))
    solved: list[DataFrame] = []
    inside = r._with(cut(r.df))
    for top in range(n - 1, -1, -block):
        low = max(0, top - block + 1)
        for k in range(top, low - 1, -1):
            on = inside.df.where((F.col(row) == k) & (F.col(col) == k)).select(*r.batch, F.col("re").alias("dr"), F.col("im").alias("di"))
            size = F.col("dr") * F.col("dr") + F.col("di") * F.col("di")
            here = left.df.where(F.col(row) == k).join(on, list(r.batch))
            x = here.select(F.lit(k).alias(row), *others, ((F.col("re") * F.col("dr") + F.col("im") * F.col("di")) / size).alias("re"), ((F.col("im") * F.col("dr") - F.col("re") * F.col("di")) / size).alias("im"))
            solved.append(cut(x))
            if k == low and low == 0:
                break
            # rows of this block only, until it is solved; then all above at once
            reach = (F.col(row) >= low) & (F.col(row) < k) if k > low else F.col(row) < low
            cols = [k] if k > low else list(range(low, top + 1))
            known = solved[-1]
            for part in solved[-len(cols) : -1]:
                known = known.unionByName(part)
            factor = inside._with(inside.df.where(reach & F.col(col).isin(cols)))
            part = Tensor(known.withColumnRenamed(row, col), tuple(col if q == row else q for q in b.index), {}, b.batch)
            taken = contract((factor, part), b.index).scale(-1.0)
            left = b._with(cut(left.add(taken).df))
    out = solved[0]
    for part in solved[1:]:
        out = out.unionByName(part)
    x = b._with(out.select(*b.keys, "re", "im"))
    return x.rename(*(col if k == row else k for k in b.index))
