"""The variational fixed point of a boundary state, for all problems of a sweep at once.

A state is a table of packed cells ``M``, ``AL``, ``AR``, ``C``, ``FL``,
``FR``. A step is six grouped maps; what moves are the cells' tensors. The
driver sees one number a step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dense
from ..functions.lineage import cut
from ..functions.ship import ship
from .cells import KEYS, SCHEMA, pack, read, unpack, write
from .contract import contract
from .environments import bonds, canonical, centres, conjugated, environments, left_orthogonal, residuals, right_orthogonal
from .tensor import Tensor, random_like

STATE = ("M", "AL", "AR", "C", "FL", "FR")


@dataclass
class Stop:
    """Says when an iteration ends: at most ``maxiter`` steps, at least ``miniter``, else once the error is ``tol`` or less."""

    tol: float = 1e-10
    maxiter: int = 10
    miniter: int = 1
    steps: int = -1

    def __call__(self, error: float) -> bool:
        self.steps += 1
        return self.steps >= self.maxiter or (error <= self.tol and self.steps >= self.miniter)


def fixed_point(step: Callable, state, stop: Stop, error: float = float("inf")):
    """The first of ``state``, ``step(state)``, ... at which to stop, with its error."""
    while not stop(error):
        state, error = step(state)
    return state, error


def _take(cells: DataFrame, *names: str) -> DataFrame:
    return cells.where(F.col("name").isin(*names))


def normalized_bulk(bulk: Tensor) -> DataFrame:
    """``M`` over the norm of its problem's whole unit cell."""
    return pack(bulk.normalized(("problem",)), "M")


def start(bulk: Tensor, chi: int, rows: int, columns: int, seed: int = 100) -> DataFrame:
    """A state of bond dimension ``chi`` from hashed numbers."""
    if len(bulk.index) != 4:
        raise ValueError(f"a bulk tensor has 4 indices and its cell, not {bulk.index}")
    m = cut(normalized_bulk(bulk))
    d = bulk.dims[bulk.index[3]]
    a = pack(random_like(bulk.df.select(*KEYS), {"a": chi, "b": d, "c": chi}, seed, KEYS), "A")
    left = cut(left_orthogonal(a))
    right = cut(right_orthogonal(left, "AL"))
    state = _take(left, "AL").unionByName(_take(right, "AR"))
    upper = state.unionByName(m)
    env = environments(upper, conjugated(state), rows=rows)
    bond = bonds(left.unionByName(right), columns)
    return cut(upper.unionByName(bond).unionByName(_take(env, "FL", "FR")))


def step(state: DataFrame, rows: int, columns: int) -> tuple[DataFrame, DataFrame]:
    """The next state, and ``problem, error`` of each problem."""
    m = _take(state, "M")
    first = cut(centres(state, columns))
    half = cut(canonical(first, columns))
    # environments between the old state and the new one
    env = _take(environments(state, conjugated(_take(half, "AL", "AR")), state, rows), "FL", "FR")
    env = cut(env)
    second = cut(centres(_take(first, "AC", "C").unionByName(m).unionByName(env), columns))
    new = cut(canonical(second, columns))
    out = m.unionByName(_take(new, "AL", "AR")).unionByName(_take(second, "C")).unionByName(env)
    missed = residuals(out).unionByName(_take(new, "EL", "ER"))
    return out, missed.groupBy("problem").agg(F.sum(F.element_at("re", 1)).alias("error"))


def solve(state: DataFrame, rows: int, columns: int, tol: float = 1e-10, maxiter: int = 10, miniter: int = 1, after: Callable | None = None) -> tuple[DataFrame, float]:
    """Steps until every problem's error is ``tol``; ``after(state, errors)`` may replace a step's state.

    A problem whose error is small enough leaves the iteration with the state it
    has then; steps after that move only the others' tensors.
    """
    stop, error = Stop(tol, maxiter, miniter), float("inf")
    working, settled, least = state, [], 0.0
    while not stop(error):
        new, errors = step(working, rows, columns)
        if after is not None:
            new = after(new, errors) or new
        errors = cut(errors)
        found = errors.agg(F.max("error").alias("worst"), F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("error") <= tol, 1)).alias("done"), F.max(F.when(F.col("error") <= tol, F.col("error"))).alias("least")).first()
        error = 0.0 if found.worst is None else found.worst
        working = new
        if stop.steps + 1 >= miniter and 0 < found.done < found.all:
            done = errors.where(F.col("error") <= tol).select("problem")
            new = cut(new)
            settled.append(cut(new.join(done, "problem", "left_semi")))
            working = cut(new.join(done, "problem", "left_anti"))
            least = max(least, found.least)
    for part in settled:
        working = working.unionByName(part)
    return working, max(error, least)


def _dense_step(t: dict, rows: int, columns: int) -> tuple[dict, float]:
    """``step`` on one network's tensors in memory."""
    at = [(i, j) for i in range(rows) for j in range(columns)]

    def lead(t: dict) -> dict:
        out = {}
        for j in range(columns):
            first = t.get(("AC", 0, j), None)
            first = np.tensordot(t["AL", 0, j], t["C", 0, j], 1) if first is None else first
            centre = dense.cyclic([lambda x, i=i: dense.centre_step(x, t["FL", i, j], t["M", i, j], t["FR", i, j]) for i in range(rows)], first)[1]
            bond = dense.cyclic([lambda x, i=i: dense.bond_step(x, t["FL", i, (j + 1) % columns], t["FR", i, j]) for i in range(rows)], t["C", 0, j])[1]
            out |= {("AC", i, j): centre[i] for i in range(rows)} | {("C", i, j): bond[i] for i in range(rows)}
        return out

    def gauge(t: dict) -> dict:
        return {k: v for i, j in at for k, v in dense.nearest_isometries(t["AC", i, j], t["C", i, j], t["C", i, (j - 1) % columns], i, j).items()}

    m = {k: x for k, x in t.items() if k[0] == "M"}
    first = lead(t)
    half = gauge(first)
    env = {}
    for i in range(rows):
        low = (i + 1) % rows
        one = [lambda x, j=j: dense.left_step(x, t["AL", i, j], t["M", i, j], half["AL", low, j].conj()) for j in range(columns)]
        two = [lambda x, j=j: dense.right_step(x, t["AR", i, j], t["M", i, j], half["AR", low, j].conj()) for j in range(columns)][::-1]
        env |= {("FL", i, j): x for j, x in enumerate(dense.cyclic(one, t["FL", i, 0])[1])}
        env |= {("FR", i, columns - 1 - j): x for j, x in enumerate(dense.cyclic(two, t["FR", i, columns - 1])[1])}
    second = lead(first | m | env)
    new = gauge(second)
    out = m | env | {k: x for k, x in (new | second).items() if k[0] in STATE}
    error = sum(float(abs(x)) for k, x in new.items() if k[0] in ("EL", "ER"))
    for j in range(columns):
        column = {k: x for k, x in out.items() if k[2] == j}
        error += sum(float(dense.outside(column, i, j, rows)) for i in range(rows))
    return out, error


def solve_whole(state: DataFrame, rows: int, columns: int, tol: float = 1e-10, maxiter: int = 10, miniter: int = 1) -> tuple[DataFrame, DataFrame]:
    """``solve`` with each problem's iteration in one grouped map, and ``problem, error``.

    For networks whose tensors fit a task many times over, of which a sweep
    has many: nothing moves between steps, and each problem stops by its own
    error. Large bonds take ``solve``, whose groups are rows, columns and cells.
    """
    ship(state.sparkSession)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        t, error = fixed_point(lambda t: _dense_step(t, rows, columns), read(frame), Stop(tol, maxiter, miniter))
        return write(int(key[0]), t | {("ERR", 0, 0): error})

    out = cut(_take(state, *STATE).groupBy("problem").applyInPandas(run, SCHEMA))
    return _take(out, *STATE), _take(out, "ERR").select("problem", F.element_at("re", 1).alias("error"))


def _folder(path: str, direction: str, chi: int, d: int) -> str:
    return f"{path}/direction={direction}/D={d}/chi={chi}"


def _latest(spark: SparkSession, folder: str) -> int | None:
    """The number of the last committed snapshot in a folder."""
    try:
        return spark.read.schema("version bigint").parquet(f"{folder}/commits").agg(F.max("version").alias("v")).first().v
    except AnalysisException:
        return None


def save(state: DataFrame, path: str, direction: str, chi: int, d: int, keep: int = 2) -> None:
    """Keep a state as a new snapshot of its direction and dimensions.

    The snapshot is written beside the older ones and then committed by a row in
    ``commits``; one that isn't committed, as its writer was lost, is never
    read. All but the last ``keep`` snapshots are emptied after that.
    """
    spark, folder = state.sparkSession, _folder(path, direction, chi, d)
    version = (_latest(spark, folder) or 0) + 1
    state.write.mode("overwrite").parquet(f"{folder}/version-{version}")
    spark.range(version, version + 1).select(F.col("id").alias("version")).coalesce(1).write.mode("append").parquet(f"{folder}/commits")
    if version > keep:
        state.limit(0).write.mode("overwrite").parquet(f"{folder}/version-{version - keep}")


def load(spark: SparkSession, path: str, direction: str, chi: int, d: int) -> DataFrame:
    """The last committed snapshot of a state, or a plain table in its place; an error if its tensors aren't of dimension ``chi``."""
    folder = _folder(path, direction, chi, d)
    version = _latest(spark, folder)
    state = spark.read.parquet(folder if version is None else f"{folder}/version-{version}")
    if not state.where("name = 'C' and shape[0] <> %d" % chi).isEmpty():
        raise ValueError(f"the state in {path} isn't of dimension {chi}")
    return state


def _kept(spark: SparkSession, path: str, *args) -> DataFrame | None:
    """A kept state, or none if there isn't one."""
    try:
        return load(spark, path, *args)
    except AnalysisException:
        return None


def boundary(bulk: Tensor, chi: int, rows: int, columns: int, direction: str = "up", folder: str | None = None, outfolder: str | None = None, downfromup: bool = False, tol: float = 1e-10, maxiter: int = 10, miniter: int = 1, savetol: float = 1e-5, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """The boundary state of ``bulk`` at its fixed point, and ``problem, error``.

    Starts from the state kept in ``folder`` for the direction and dimensions
    if there is one, else from hashed numbers. The result is kept in
    ``outfolder`` once every problem's error is under ``savetol``.
    ``downfromup`` lets the state from below start from (and be kept as) that
    from above. ``whole``: each problem in one task.
    """
    spark = bulk.df.sparkSession
    direction = "up" if downfromup else direction
    d = bulk.dims[bulk.index[0]]
    old = _kept(spark, folder, direction, chi, d) if folder else None
    state = start(bulk, chi, rows, columns) if old is None else cut(old.where("name <> 'M'").unionByName(normalized_bulk(bulk)))
    if whole:
        state, errors = solve_whole(state, rows, columns, tol, maxiter, miniter)
    else:
        state, worst = solve(state, rows, columns, tol, maxiter, miniter)
        state = cut(state)
        errors = state.select("problem").distinct().withColumn("error", F.lit(worst))
    if outfolder and errors.where(F.col("error") >= savetol).isEmpty():
        save(state, outfolder, direction, chi, d)
    return state, errors


def flipped(bulk: Tensor, rows: int) -> Tensor:
    """The network as seen from below: what was down is up."""
    left, down, right, up = bulk.index
    return bulk.flip(down, up, "i", rows)


def observable_environment(bulk: Tensor, chi: int, rows: int, columns: int, updown: bool = True, downfromup: bool = False, folder: str | None = None, outfolder: str | None = None, savetol: float = 1e-5, **how) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The state from above, that from below (none unless ``updown``), and ``FL``, ``FR`` between the two.

    The bulk is taken over its norm. Environments kept in ``folder`` are the
    first guess, else those of the state from above; they are kept in
    ``outfolder`` where both errors together are under ``savetol``.
    """
    bulk = bulk.normalized(("problem",))
    bulk = bulk._with(cut(bulk.df))
    spark, d = bulk.df.sparkSession, bulk.dims[bulk.index[0]]
    both = dict(how, folder=folder, outfolder=outfolder, savetol=savetol)
    up, errors = boundary(bulk, chi, rows, columns, "up", **both)
    down = None
    if updown:
        below = flipped(bulk, rows)
        down, more = boundary(below._with(cut(below.df)), chi, rows, columns, "down", downfromup=downfromup, **both)
        errors = errors.unionByName(more)
    guess = _kept(spark, folder, "observed", chi, d) if folder else None
    env = cut(observing(up, down, rows, up if guess is None else guess))
    total = errors.groupBy("problem").agg((F.sum("error") * (1 if updown else 2)).alias("error"))
    if outfolder and total.where(F.col("error") >= savetol).isEmpty():
        save(env, outfolder, "observed", chi, d)
    return up, down, env


def observing(up: DataFrame, down: DataFrame | None, rows: int, guess: DataFrame | None = None) -> DataFrame:
    """``FL``, ``FR`` between the state from above and that from below (none: the same), rows mirrored."""
    lower = _take(up if down is None else down, "AL", "AR")
    return environments(_take(up, "AL", "AR", "M"), conjugated(lower), None if guess is None else _take(guess, "FL", "FR"), rows=rows, mirrored=True)


def _quotient(n: Tensor, m: Tensor) -> DataFrame:
    """``KEYS, re, im`` of the quotient of two scalars of each cell."""
    y = m.df.select(*KEYS, F.col("re").alias("yr"), F.col("im").alias("yi"))
    size = F.col("yr") * F.col("yr") + F.col("yi") * F.col("yi")
    re = F.try_divide(F.col("re") * F.col("yr") + F.col("im") * F.col("yi"), size)
    im = F.try_divide(F.col("im") * F.col("yr") - F.col("re") * F.col("yi"), size)
    return n.df.join(y, list(KEYS)).select(*KEYS, re.alias("re"), im.alias("im"))


def _centre(state: DataFrame, chi: int, d: int) -> Tensor:
    return contract((unpack(state, "AL", "apc", (chi, d, chi)), unpack(state, "C", "cb", (chi, chi))), "apb").rename("a", "b", "c")


def partition_per_site(state: DataFrame, bulk: Tensor, chi: int, rows: int, columns: int) -> DataFrame:
    """``problem, z``: the geometric mean over cells of the norm with ``bulk`` over that without."""
    d, e = bulk.dims[bulk.index[3]], bulk.dims[bulk.index[0]]
    left, right = unpack(state, "FL", "adf", (chi, e, chi)), unpack(state, "FR", "ceh", (chi, e, chi))
    bond, centre = unpack(state, "C", "ab", (chi, chi)), _centre(state, chi, d)
    z = contract(((((left, centre), bulk), right), centre.conj().rename("f", "g", "h").shift("i", -1, rows)))
    one = contract((((left.rename("a", "c", "d").shift("j", -1, columns), bond), right.rename("b", "c", "e")), bond.conj().rename("d", "e").shift("i", -1, rows)))
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return _quotient(z, one).groupBy("problem").agg(F.exp(F.avg(F.log(size))).alias("z"))


def _around(up: DataFrame, env: DataFrame, bulk: Tensor, chi: int, rows: int, down: DataFrame | None) -> Tensor:
    """Of each cell the network with the place of its own tensor left open."""
    d, e = bulk.dims[bulk.index[3]], bulk.dims[bulk.index[0]]
    left, right = unpack(env, "FL", "adf", (chi, e, chi)), unpack(env, "FR", "ceh", (chi, e, chi))
    upper = _centre(up, chi, d)
    lower = (upper if down is None else _centre(down, chi, d)).conj().rename("f", "g", "h").mirror("i", rows)
    around = contract(((left, upper), (lower, right)), "dgeb")
    return around._with(cut(around.df))


def expectation(up: DataFrame, env: DataFrame, inserted: Tensor, bulk: Tensor, chi: int, rows: int, down: DataFrame | None = None) -> DataFrame:
    """``problem, re, im``: the mean over cells of the network with ``inserted`` over that with ``bulk``."""
    around = _around(up, env, bulk, chi, rows, down)
    found = _quotient(contract((around, inserted)), contract((around, bulk)))
    return found.groupBy("problem").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))


def gradient(up: DataFrame, env: DataFrame, bulk: Tensor, chi: int, rows: int, columns: int, down: DataFrame | None = None) -> Tensor:
    """The derivative of the logarithm of the partition function per site by every entry of ``bulk``.

    At the fixed point the boundary is stationary: what its own change adds
    vanishes to first order, so the derivative by a cell's tensor is what
    surrounds it, over the network's value and the number of cells.
    """
    around = _around(up, env, bulk, chi, rows, down)
    whole = contract((around, bulk)).df.select(*KEYS, F.col("re").alias("yr"), F.col("im").alias("yi"))
    size = (F.col("yr") * F.col("yr") + F.col("yi") * F.col("yi")) * (rows * columns)
    re = F.try_divide(F.col("re") * F.col("yr") + F.col("im") * F.col("yi"), size)
    im = F.try_divide(F.col("im") * F.col("yr") - F.col("re") * F.col("yi"), size)
    return around._with(around.df.join(whole, list(KEYS)).select(*around.index, *KEYS, re.alias("re"), im.alias("im")))
