"""Gradients by central differences: every end of every difference is a problem of one sweep.

A table of perturbations (an entry, its real or imaginary part, up or down) makes
a problem of each of its rows: the problem's own entries, one of them moved by
half a step. The function runs once, on all of them, and the differences of its
values are joined back by entry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .tensor import Tensor

#: The ends of the differences: which part moves, and where to.
SIDES = ((0, 1), (0, -1), (1, 1), (1, -1))


def num_grad(f: Callable[[DataFrame], DataFrame], rows: DataFrame, keys: tuple[str, ...] = (), step: float = 1e-5, parts: int = 2) -> DataFrame:
    """``problem, keys, re, im``: (f(x + step / 2) - f(x - step / 2)) / step for each entry x, by its real part and (times i) its imaginary one.

    ``rows`` has ``problem`` and, where it has several entries, ``keys`` that
    tell them apart, ``re`` and for ``parts=2`` ``im``; an entry that isn't a
    row isn't moved. ``f`` takes such a table, with problems of its own
    numbering and ``base``, the problem each came from, and gives ``problem,
    value`` with a real value; of a problem without a value the gradient is null. With ``parts=1`` entries are
    real and so is the gradient. A problem of n entries becomes 2 * parts * n
    problems of n entries each, so f's work is the square of n and in
    proportion to the number of problems.
    """
    sides = SIDES[: 2 * parts]
    names = ("re", "im")[:parts]
    numbered = rows.select("problem", *keys, *names, (F.row_number().over(Window.partitionBy("problem").orderBy(*(keys or ("problem",)))) - 1).alias("entry"))
    numbered = cut(numbered)
    most = numbered.agg(F.max("entry").alias("n")).first().n
    span = len(sides) * (1 if most is None else most + 1)
    ends = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.lit(part).alias("part"), F.lit(sign * step / 2).alias("by")) for k, (part, sign) in enumerate(sides))))
    # problems keep their order, spread out so that their perturbations fit between
    number = F.col("problem").cast("long") * span + F.col("moved") * len(sides) + F.col("end.side")
    moves = numbered.select("problem", F.col("entry").alias("moved"), ends.alias("end"))
    moves = moves.select("problem", "moved", "end.*", number.alias("moved_problem"))
    shifted = [(F.col(name) + F.when((F.col("entry") == F.col("moved")) & (F.col("part") == part), F.col("by")).otherwise(0.0)).alias(name) for part, name in enumerate(names)]
    ran = f(numbered.join(moves, "problem").select(F.col("moved_problem").alias("problem"), F.col("problem").alias("base"), *keys, *shifted)).select("problem", "value")
    back = F.expr(f"(problem - pmod(problem, {span}L)) div {span}L")
    place = F.pmod("problem", F.lit(span))
    entry, side = F.floor(place / len(sides)).cast("int"), F.pmod(place, F.lit(len(sides))).cast("int")
    slopes = [F.sum(F.when(F.col("side") == 2 * part, F.col("value")).when(F.col("side") == 2 * part + 1, 0 - F.col("value"))) / step for part in range(parts)]
    found = ran.select(back.alias("problem"), entry.alias("entry"), side.alias("side"), "value").groupBy("problem", "entry").agg(*(s.alias(n) for s, n in zip(slopes, names, strict=True)))
    return numbered.select("problem", *keys, "entry").join(found, ["problem", "entry"], "left").select("problem", *keys, *names)


def num_grad_tensor(f: Callable[[Tensor, DataFrame], DataFrame], x: Tensor, step: float = 1e-5) -> Tensor:
    """The gradient by every entry of a tensor with ``problem`` among its batch columns.

    ``f`` takes such a tensor and ``problem, base``, and gives ``problem, value``.
    """
    keys = tuple(k for k in x.keys if k != "problem")

    def run(rows: DataFrame) -> DataFrame:
        rows = cut(rows)
        return f(x._with(rows.select(*x.keys, "re", "im")), rows.select("problem", "base").distinct())

    return x._with(num_grad(run, x.df, keys, step).select(*x.keys, "re", "im"))


def lifted(x: Tensor, bases: DataFrame) -> Tensor:
    """A tensor of the problems that perturbed ones came from, for each of these."""
    rows = x.df.withColumnRenamed("problem", "base").join(bases, "base")
    return x._with(rows.select(*x.keys, "re", "im"))
