"""Tensors of a unit cell gathered from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators.tensor import Tensor

#: Rows and columns of the unit cell.
CELL = 3

#: The index columns of each tensor, as expressions on ``lineitem``, and their sizes.
LINEITEM = {
    "M": {"d": ("l_partkey", 2), "g": ("l_suppkey", 2), "e": ("l_orderkey", 2), "b": ("l_linenumber", 2)},
    "AU": {"a": ("l_orderkey", 4), "b": ("l_linenumber", 2), "c": ("l_partkey", 4)},
    "AD": {"f": ("l_partkey", 4), "g": ("l_linenumber", 2), "h": ("l_orderkey", 4)},
    "FL": {"a": ("l_partkey", 4), "d": ("l_linenumber", 2), "f": ("l_suppkey", 4)},
    "FR": {"c": ("l_suppkey", 4), "e": ("l_linenumber", 2), "h": ("l_orderkey", 4)},
    "C": {"a": ("l_suppkey", 4), "b": ("l_partkey", 4)},
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tensor(rows: DataFrame, name: str) -> Tensor:
    index = LINEITEM[name]
    keys = [F.pmod(F.col(c).cast("int"), F.lit(n)).alias(k) for k, (c, n) in index.items()]
    df = rows.groupBy(*keys, "i", "j").agg(F.sum("re").cast("double").alias("re"), F.sum("im").cast("double").alias("im"))
    return Tensor(df, tuple(index), {k: n for k, (_, n) in index.items()})


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", -1).otherwise(0)
    cell = (F.pmod(F.col("l_quantity").cast("int"), F.lit(CELL)).alias("i"), F.pmod(F.month("l_shipdate"), F.lit(CELL)).alias("j"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *cell, F.lit(1).alias("re"), flag.alias("im"))


def lineitem_tensor(spark: SparkSession, sf_dir: str, name: str) -> Tensor:
    """One of LINEITEM: entries count rows, the imaginary part returns less acceptances.

    One aggregation, combined before its shuffle: what moves is at most an
    entry of the (small, dense) tensor for each task, whatever the table's size.
    """
    return _tensor(_entries(spark, sf_dir), name)


def lineitem_tensors(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> list[Tensor]:
    """Several of LINEITEM from one scan: rows are summed by what all tensors' indices follow from, 1152 sums at most, and kept."""
    most = {c: max(n for index in LINEITEM.values() for k, n in index.values() if k == c) for index in LINEITEM.values() for c, _ in index.values()}
    keys = [F.pmod(F.col(c).cast("int"), F.lit(n)).alias(c) for c, n in sorted(most.items())]
    sums = cut(_entries(spark, sf_dir).groupBy(*keys, "i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im")))
    return [_tensor(sums, name) for name in names]
