"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its least node) of every node in ``links`` (``a, b``).

    Each round takes the least label among a node and its neighbours and then
    that label's own label, so long chains shorten by more than half; every
    round is a table in the shared folder.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("component").alias("m"))
        new = cut(labels.join(near, F.col("node") == F.col("n")).select("node", "component", F.least("component", "m").alias("l")), "labels")
        up = new.select(F.col("node").alias("n"), F.col("l").alias("up"))
        new = cut(new.join(up, F.col("l") == F.col("n"), "left").select("node", F.col("component").alias("old"), F.least(F.col("l"), F.col("up")).alias("component")), "labels")
        labels = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            return labels
