"""Where intermediate tables of the corpus operators are kept.

Lineage is cut by writing a Parquet table into the folder that the cluster
shares (``spark.checkpoint.dir``), so that a lost executor costs a re-read and
never a recomputation of everything before.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode where none is set."""
    global _local_dir
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="tessellar-")
    return _local_dir


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch of documents; Spark's default is 64 MB.
ARROW_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ARROW_BYTES, unless the session's user has chosen a size.

    A batch of long texts is held several times over, in the JVM's direct
    memory and in Python.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "67108864", "64m"):
        spark.conf.set(name, str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text):
    """Lower-case A-Z only.

    For a text of ASCII alone ``lower`` is the same and much faster than
    ``translate``, which goes through a dictionary for each character.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


#: Ids of so many rows are broadcast (8 bytes each, some 25 as a hash table); beyond, both sides are shuffled.
BROADCAST_IDS = 2_000_000


def by_ids(rows: DataFrame, key: str, ids: DataFrame, how: str, most: int | None = None) -> DataFrame:
    """``rows`` whose ``key`` is (``left_semi``) or isn't (``left_anti``) in the one column of ``ids``, a table that was cut.

    The rows, which hold the texts, stay where they are as long as the ids are few enough.
    """
    (name,) = ids.columns
    few = ids.count() <= (BROADCAST_IDS if most is None else most)
    other = ids.withColumnRenamed(name, "__other")
    return rows.join(F.broadcast(other) if few else other, F.col(key) == F.col("__other"), how)


def repeats(rows: DataFrame, key: str) -> bool:
    """Whether an id other than null stands on several rows."""
    return not rows.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty()
