"""Tensors of the two-dimensional Ising model for a table of inverse temperatures.

All are column expressions and joins on ``beta``: a sweep over many
temperatures is one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contract import contract
from .tensor import Tensor


def beta_critical() -> Column:
    return F.log(F.lit(1.0) + F.sqrt(F.lit(2.0))) / 2


def magnetization(beta: Column) -> Column:
    """The exact magnetisation: 0 above the critical temperature."""
    return F.when(beta > beta_critical(), F.pow(F.lit(1.0) - F.pow(F.sinh(beta * 2), F.lit(-4.0)), F.lit(0.125))).otherwise(0.0)


def _matrix(betas: DataFrame, name: tuple[str, str], same: Column, differ: Column) -> Tensor:
    """A symmetric 2 x 2 matrix for each beta."""
    a, b = name
    legs = [F.explode(F.array(F.lit(0), F.lit(1))).alias(a)]
    df = betas.select("beta", *legs).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias(b))
    return Tensor(df.select(a, b, "beta", F.when(F.col(a) == F.col(b), same).otherwise(differ).alias("re"), F.lit(0.0).alias("im")), name, {a: 2, b: 2}, ("beta",))


def root(betas: DataFrame, a: str, b: str) -> Tensor:
    """The square root of the Boltzmann weights exp(beta s t)."""
    up, down = F.sqrt(F.cosh("beta") * 2), F.sqrt(F.sinh("beta") * 2)
    return _matrix(betas, (a, b), (up + down) / 2, (up - down) / 2)


def inverse_root(betas: DataFrame, a: str, b: str) -> Tensor:
    up, down = 1 / F.sqrt(F.cosh("beta") * 2), 1 / F.sqrt(F.sinh("beta") * 2)
    return _matrix(betas, (a, b), (up + down) / 2, (up - down) / 2)


def energy_weights(betas: DataFrame, a: str, b: str) -> Tensor:
    """The bond energy times its weight."""
    return _matrix(betas, (a, b), -F.exp("beta"), F.exp(-F.col("beta")))


def bulk(betas: DataFrame, legs: str = "abcd") -> Tensor:
    """Four roots that share one spin: each leg's factor has it, so it is summed with the last."""
    w = [root(betas, "s", k) for k in legs]
    return contract((((w[0], w[1]), w[2]), w[3]), legs)


def bulk_slope(betas: DataFrame, legs: str = "abcd") -> Tensor:
    """The derivative of ``bulk`` by beta: the sum over legs of the tensor with that leg's root replaced by its slope."""
    up, down = F.sinh("beta") / F.sqrt(F.cosh("beta") * 2), F.cosh("beta") / F.sqrt(F.sinh("beta") * 2)
    total = None
    for leg in legs:
        slope = _matrix(betas, ("s", leg), (up + down) / 2, (up - down) / 2)
        w = [root(betas, "s", k) for k in legs if k != leg]
        part = contract((((slope, w[0]), w[1]), w[2]), legs)
        total = part if total is None else total.add(part)
    return total


def magnetic(betas: DataFrame, legs: str = "abcd") -> Tensor:
    """The same with the spin's sign."""
    first = root(betas, "s", legs[0])
    signed = Tensor(first.df.withColumn("re", F.when(F.col("s") == 0, F.col("re")).otherwise(-F.col("re"))), first.index, first.dims, first.batch)
    w = [root(betas, "s", k) for k in legs[1:]]
    return contract((((signed, w[0]), w[1]), w[2]), legs)


def energy(betas: DataFrame, legs: str = "abcd") -> Tensor:
    """Half the sum over legs of the tensor with that leg's bond energy."""
    total = None
    for k in range(4):
        x = contract((inverse_root(betas, legs[k], "t"), energy_weights(betas, "t", "s")), (legs[k], "s"))
        others = [root(betas, "s", leg) for leg in legs if leg != legs[k]]
        part = contract((((x, others[0]), others[1]), others[2]), legs)
        total = part if total is None else total.add(part)
    return total.scale(0.5)
