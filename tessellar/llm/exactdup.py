"""Exact deduplication over a persistent digest index.

The index is two Spark tables bucketed and sorted by the SHA-256 of the
normalised text (A-Z lower-cased), kept in the shared folder. A batch is first
aggregated to one row a digest (map-side, so a text with a third of all rows
shrinks before the shuffle). A sort-merge anti-join with the first table finds
the digests that are new, which are appended to it; what a batch adds to known
digests is appended to the second. Reading joins the two bucket by bucket.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import ascii_lower, by_ids, cut, repeats, shared_dir

#: A digest with more than 1/HOT of a batch's rows is hot; so there are fewer than HOT hot digests.
HOT = 1000
#: Batches in which a table without an index of its own goes in.
BATCHES = 2


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest`` (binary SHA-256) of every row; a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("id"), digest(F.col(text_col)).alias("digest"))


class DigestIndex:
    """Tables ``name`` (``digest, keep_id, group_size``, once a digest) and ``name_more`` (what later batches added).

    Of equal texts, within a batch or across batches, the row of the largest
    id stays (a null id only where all ids of a group are null), so a later
    batch can take a digest over. Appends of one index go one after another.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name, self.more = spark, name, f"{name}_more"
        if not spark.catalog.tableExists(name):
            n = buckets or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
            empty = spark.createDataFrame([], "digest binary, keep_id bigint, group_size bigint")
            for table in (name, self.more):
                self._write(empty, table, n)
        self.buckets = int(next(r.data_type for r in spark.sql(f"DESCRIBE FORMATTED {name}").collect() if r.col_name == "Num Buckets"))

    def _write(self, rows: DataFrame, table: str, n: int) -> None:
        out = rows.write.mode("append").format("parquet").bucketBy(n, "digest").sortBy("digest")
        if not self.spark.catalog.tableExists(table):
            out = out.option("path", f"{shared_dir(self.spark)}/{table}-{uuid.uuid4().hex}")
        out.saveAsTable(table)

    def read(self) -> DataFrame:
        """``digest, keep_id, group_size`` over all batches; equal buckets meet, nothing is shuffled."""
        more = self.spark.table(self.more).groupBy("digest").agg(F.max("keep_id").alias("later"), F.sum("group_size").alias("added"))
        rows = self.spark.table(self.name).hint("merge").join(more, "digest", "left")
        return rows.select("digest", F.greatest("keep_id", "later").alias("keep_id"), (F.col("group_size") + F.coalesce("added", F.lit(0))).alias("group_size"))

    def append(self, batch: DataFrame) -> None:
        """``batch``: id, digest. A digest that the index doesn't have gets a row; of others the ids and numbers are added."""
        groups = batch.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        # Written first: the optimizer would move an anti-join below the aggregation, where a frequent text's rows meet in one task.
        groups = cut(groups, "groups")
        known = self.spark.table(self.name).select("digest").hint("merge")
        old = cut(groups.join(known, "digest", "left_semi"), "known")
        new = groups.join(known, "digest", "left_anti")
        # one task a bucket, by the same hash as the buckets: one file each
        self._write(new.repartition(self.buckets, "digest"), self.name, self.buckets)
        if not old.isEmpty():
            self._write(old.repartition(self.buckets, "digest"), self.more, self.buckets)

    def compact(self) -> None:
        """One sorted file a bucket again, and nothing in the second table: after many appends."""
        rows = cut(self.read(), "compacted")
        empty = rows.where("false")
        self.drop()
        self._write(rows.repartition(self.buckets, "digest"), self.name, self.buckets)
        self._write(empty, self.more, self.buckets)

    def drop(self) -> None:
        """The tables leave the catalog; their files, as all in the shared folder, go by age."""
        for table in (self.name, self.more):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: str | None = None, batches: int = BATCHES) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    ``index`` names a persistent index to which the rows are added as one
    batch; groups then reach over all of its batches. Left out, the rows go in
    ``batches`` batches, by a hash of their digest and id, into an index of
    their own, which is dropped in the end. Rows with the same id are separate
    rows; where they also have the same text and the largest id, the flag
    ``kept`` holds for each of them. A row with a null id is kept only if its
    group has no id at all. An empty table gives an empty result; other
    columns are not read.
    """
    spark = docs.sparkSession
    rows = cut(digests(docs, id_col, text_col), "digests")
    table = DigestIndex(spark, index or f"digest_index_{uuid.uuid4().hex}")
    if index:
        table.append(rows)
    else:
        for k in range(batches):
            table.append(rows.where(F.pmod(F.xxhash64("id", "digest"), F.lit(batches)) == k))
    known = table.read()
    count = rows.count()
    # Fewer than HOT digests can have more than 1/HOT of the rows each, so this side is bounded whatever the input.
    hot = rows.groupBy("digest").count().where(F.col("count") > count // HOT + 1).select("digest")
    hot = F.broadcast(cut(known.join(F.broadcast(hot), "digest", "left_semi").select("digest", "keep_id", "group_size"), "hot"))
    few = rows.join(hot, "digest")
    rest = rows.join(hot.select("digest"), "digest", "left_anti").join(known.hint("merge"), "digest")
    out = few.unionByName(rest).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    if index:
        return out
    out = cut(out, "exact")
    table.drop()
    return out


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, that of the largest id, whatever other texts have the same id.

    Where no id is null or repeated, the ids of the rows that go decide, and
    texts don't move while these are few enough to be broadcast.
    """
    # an index that is dropped at once needs no second batch
    found = exact_duplicates(docs, id_col, text_col, batches=1)
    if found.where(F.col(id_col).isNull()).isEmpty() and not repeats(found, id_col):
        return by_ids(docs, id_col, cut(found.where("not kept").select(id_col), "gone"), "left_anti")
    stay = found.where("kept").groupBy(F.col(id_col).alias("__stay"), F.unhex("text_sha256").alias("__text")).agg(F.count(F.lit(1)).alias("__n"))
    stay = cut(stay, "stay")
    kept = docs.withColumn("__digest", digest(F.col(text_col))).join(stay, (F.col("__digest") == F.col("__text")) & F.col(id_col).eqNullSafe(F.col("__stay")), "left_semi")
    # Whole rows are only sorted for this where an id does repeat with one text.
    return (kept if stay.where("__n > 1").isEmpty() else kept.dropDuplicates(["__digest"])).drop("__digest")
