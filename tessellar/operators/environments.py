"""Leading eigenvectors of the transfer maps, and canonical forms, by group.

Environments of a row need that row's tensors (key: problem and row), centre
and bond tensors those of a column, gauges those of a cell. All tables are
packed cells (see ``cells``); each function returns packed cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dense
from ..functions.ship import ship
from .cells import KEYS, SCHEMA, moved, pack, read, write
from .tensor import random_like


def _only(cells: DataFrame, *names: str) -> DataFrame:
    return cells.where(F.col("name").isin(*names))


def _below(rows: int, mirrored: bool):
    """Where the lower state of a row is kept: one further down, or as seen from the other side."""
    return F.lit(rows - 1) - F.col("i") if mirrored else F.pmod(F.col("i") - 1, F.lit(rows))


def _environments(left: bool, right: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        t = read(rows)
        problem, i = int(key[0]), int(key[1])
        columns = sum(name == "M" for name, _, _ in t)
        of = lambda name: [t[name, i, j] for j in range(columns)]
        out = {}
        if left:
            steps = [lambda x, u=u, m=m, d=d: dense.left_step(x, u, m, d) for u, m, d in zip(of("AL"), of("M"), of("DL"), strict=True)]
            a, d, f = t["AL", i, 0].shape[0], t["M", i, 0].shape[0], t["DL", i, 0].shape[0]
            value, found = dense.cyclic(steps, t.get(("FL", i, 0), np.ones((a, d, f))))
            out |= {("FL", i, j): x for j, x in enumerate(found)} | {("VL", i, 0): value}
        if right:
            steps = [lambda x, u=u, m=m, d=d: dense.right_step(x, u, m, d) for u, m, d in zip(of("AR"), of("M"), of("DR"), strict=True)][::-1]
            last = columns - 1
            c, e, h = t["AR", i, last].shape[2], t["M", i, last].shape[2], t["DR", i, last].shape[2]
            value, found = dense.cyclic(steps, t.get(("FR", i, last), np.ones((c, e, h))))
            out |= {("FR", i, last - k): x for k, x in enumerate(found)} | {("VR", i, 0): value}
        return write(problem, out)

    return run


def environments(upper: DataFrame, lower: DataFrame, guess: DataFrame | None = None, rows: int = 1, mirrored: bool = False, left: bool = True, right: bool = True) -> DataFrame:
    """``FL``, ``FR`` and their eigenvalues ``VL``, ``VR`` (one a row, at column 0).

    ``upper`` has ``AL``, ``AR``, ``M``; ``lower`` the states below as ``AL``,
    ``AR``, taken as they are (conjugate them first). ``guess`` may hold
    earlier ``FL``, ``FR``.
    """
    ship(upper.sparkSession)
    row = _below(rows, mirrored)
    parts = _only(upper, "AL", "AR", "M").unionByName(moved(lower, "AL", "DL", i=row)).unionByName(moved(lower, "AR", "DR", i=row))
    if guess is not None:
        parts = parts.unionByName(_only(guess, "FL", "FR"))
    return parts.groupBy("problem", "i").applyInPandas(_environments(left, right), SCHEMA)


def random_environments(at: DataFrame, left: dict[str, int], right: dict[str, int], seed: int = 100) -> DataFrame:
    """First guesses ``FL`` and ``FR`` of every cell (``problem, i, j``) in a table, from hashed numbers: the same in every run.

    ``left`` and ``right`` are the indices and dimensions, upper, bulk and lower leg.
    """
    one, two = random_like(at, left, seed, KEYS), random_like(at, right, seed + 1, KEYS)
    return pack(one, "FL").unionByName(pack(two, "FR"))


def conjugated(cells: DataFrame) -> DataFrame:
    return cells.withColumn("im", F.transform("im", lambda x: F.lit(0.0) - x))


def _centres(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    t = read(rows)
    problem, j = int(key[0]), int(key[1])
    count = sum(name == "M" for name, _, _ in t)
    first = t["AC", 0, j] if ("AC", 0, j) in t else np.tensordot(t["AL", 0, j], t["C", 0, j], 1)
    steps = [lambda x, i=i: dense.centre_step(x, t["FL", i, j], t["M", i, j], t["FR", i, j]) for i in range(count)]
    value, centre = dense.cyclic(steps, first)
    steps = [lambda x, i=i: dense.bond_step(x, t["FN", i, j], t["FR", i, j]) for i in range(count)]
    other, bond = dense.cyclic(steps, t["C", 0, j])
    out = {("AC", i, j): x for i, x in enumerate(centre)} | {("C", i, j): x for i, x in enumerate(bond)}
    return write(problem, out | {("VA", 0, j): value, ("VC", 0, j): other})


def _next_left(cells: DataFrame, columns: int) -> DataFrame:
    return moved(cells, "FL", "FN", j=F.pmod(F.col("j") - 1, F.lit(columns)))


def centres(cells: DataFrame, columns: int) -> DataFrame:
    """``AC``, ``C`` and their eigenvalues ``VA``, ``VC`` (one a column, at row 0).

    ``cells`` has ``M``, ``FL``, ``FR`` and as guesses ``C`` with ``AC`` or ``AL``.
    """
    ship(cells.sparkSession)
    parts = _only(cells, "M", "FL", "FR", "AC", "AL", "C").unionByName(_next_left(cells, columns))
    return parts.groupBy("problem", "j").applyInPandas(_centres, SCHEMA)


def _canonical(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    t = read(rows)
    problem, i, j = map(int, key)
    return write(problem, dense.nearest_isometries(t["AC", i, j], t["C", i, j], t["CB", i, j], i, j))


def canonical(cells: DataFrame, columns: int) -> DataFrame:
    """``AL``, ``AR`` nearest to ``AC``, ``C`` of each cell, and what they miss as ``EL``, ``ER``."""
    ship(cells.sparkSession)
    before = moved(cells, "C", "CB", j=F.pmod(F.col("j") + 1, F.lit(columns)))
    return _only(cells, "AC", "C").unionByName(before).groupBy("problem", "i", "j").applyInPandas(_canonical, SCHEMA)


def _gauge(left: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        (x,) = read(rows).values()
        problem, i, j = map(int, key)
        if left:
            q, l, size = dense.left_gauge(x)
            return write(problem, {("AL", i, j): q, ("L", i, j): l, ("NL", i, j): size})
        q, r, size = dense.left_gauge(x.transpose(2, 1, 0))
        return write(problem, {("AR", i, j): q.transpose(2, 1, 0), ("R", i, j): r.T, ("NR", i, j): size})

    return run


def left_orthogonal(cells: DataFrame, name: str = "A") -> DataFrame:
    """``AL``, ``L`` and the factor ``NL`` of each cell: NL * AL L = L A."""
    ship(cells.sparkSession)
    return _only(cells, name).groupBy("problem", "i", "j").applyInPandas(_gauge(True), SCHEMA)


def right_orthogonal(cells: DataFrame, name: str = "A") -> DataFrame:
    """``AR``, ``R`` and ``NR``: NR * R AR = A R."""
    ship(cells.sparkSession)
    return _only(cells, name).groupBy("problem", "i", "j").applyInPandas(_gauge(False), SCHEMA)


def _bonds(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    t = read(rows)
    problem, i, j = map(int, key)
    return write(problem, {("C", i, j): t["L", i, j] @ t["RN", i, j]})


def bonds(cells: DataFrame, columns: int) -> DataFrame:
    """``C`` = ``L`` of a column times ``R`` of the next."""
    after = moved(cells, "R", "RN", j=F.pmod(F.col("j") - 1, F.lit(columns)))
    return _only(cells, "L").unionByName(after).groupBy("problem", "i", "j").applyInPandas(_bonds, SCHEMA)


def _residual(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    t = read(rows)
    problem, j = int(key[0]), int(key[1])
    count = sum(name == "M" for name, _, _ in t)
    return write(problem, {("E", i, j): dense.outside(t, i, j, count) for i in range(count)})


def residuals(cells: DataFrame) -> DataFrame:
    """``E``: what the centre's map leaves outside the state's tangent space, once down through all rows."""
    ship(cells.sparkSession)
    return _only(cells, "AL", "AR", "C", "M", "FL", "FR").groupBy("problem", "j").applyInPandas(_residual, SCHEMA)
