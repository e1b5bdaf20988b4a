"""Contractions: a join on shared indices, then a sum over those that go.

Factors are contracted in pairs in the order given, and each pair is summed at
once, so the product of all factors is never a table. The batch columns are
keys of the join and of the sum.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .tensor import Tensor


def pair(x: Tensor, y: Tensor, out: tuple[str, ...]) -> Tensor:
    """Sum over every index that isn't in ``out``."""
    keys = [k for k in x.keys if k in y.keys]
    batch = tuple(k for k in dict.fromkeys(x.batch + y.batch))
    left = x.df.select(*x.keys, F.col("re").alias("xr"), F.col("im").alias("xi"))
    right = y.df.select(*y.keys, F.col("re").alias("yr"), F.col("im").alias("yi"))
    joined = left.join(right, keys) if keys else left.join(F.broadcast(right))
    re = F.sum(F.col("xr") * F.col("yr") - F.col("xi") * F.col("yi")).alias("re")
    im = F.sum(F.col("xr") * F.col("yi") + F.col("xi") * F.col("yr")).alias("im")
    return Tensor(joined.groupBy(*out, *batch).agg(re, im), out, {k: n for k, n in {**x.dims, **y.dims}.items() if k in out}, batch)


def contract(tree, out: str | tuple[str, ...] = ()) -> Tensor:
    """A nested pair of tensors, contracted from the inside: ``contract(((x, y), z), "abc")``.

    An index is summed once nothing outside the pair has it, so one that more
    than two factors share stays to the last of them.
    """
    out = tuple(out)

    def indices(node) -> set[str]:
        return set(node.index) if isinstance(node, Tensor) else indices(node[0]) | indices(node[1])

    def go(node, outside: set[str], final: tuple[str, ...] | None) -> Tensor:
        if isinstance(node, Tensor):
            return node
        a, b = node
        x = go(a, outside | indices(b), None)
        y = go(b, outside | indices(a), None)
        keep = final if final is not None else tuple(k for k in dict.fromkeys(x.index + y.index) if k in outside)
        return pair(x, y, keep)

    return go(tree, set(out), out)
