"""Cutting the lineage of iterations."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint in the folder that the cluster shares (``spark.checkpoint.dir``)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        found = context.getConf().get("spark.checkpoint.dir")
        if not found and not (context.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="tessellar-"))
    return df.checkpoint()
