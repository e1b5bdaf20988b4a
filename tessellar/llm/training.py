"""Labelled rows and features that the two classifiers share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from .store import cut

#: Labelled documents that a classifier is fitted on, at most; which, follows from a hash of the id.
SAMPLE = 8000
#: Bytes of features that they may have in all: what goes to the driver, however long the texts.
SAMPLE_BYTES = 192 << 20


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Rows that no label is learnt from: a fifth, by the CRC of the id as text."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, bound: int = SAMPLE) -> DataFrame:
    """``label, place, text`` of at most ``bound`` labelled rows that aren't held out; ``place`` is the hash that chose them.

    Only labels that have a document count towards the bound. A repeated id
    counts once in the labels (its largest label).
    """
    key = F.col(id_col)
    known = labels.where(F.col(label).isNotNull() & key.isNotNull() & ~held_out(key)).groupBy(key.alias("__id")).agg(F.max(label).cast("int").alias("label"))
    known = known.join(docs.select(key.alias("__id")), "__id", "left_semi").withColumn("place", F.xxhash64("__id"))
    chosen = known.orderBy("place", "__id").limit(bound)
    # bounded by the sample's size: 20 bytes a row
    texts = docs.select(key.alias("__doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("label", "place", "text")


def features(rows: DataFrame, run: Callable[[pa.Array], Iterator[np.ndarray]], most: int = SAMPLE_BYTES) -> list[tuple[int, np.ndarray]]:
    """Of each (bounded) labelled row its label and ``run``'s array of 32-bit integers, in a fixed order.

    Of rows with more than ``most`` bytes of features in all, the first by
    ``place`` that have no more.
    """
    ship(rows.sparkSession)

    def apply(batches):
        for batch in batches:
            blobs = [x.astype("<i4").tobytes() for x in run(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["label", "place", "features"])

    made = cut(rows.mapInArrow(apply, "label int, place bigint, features binary"), "features")
    sizes = sorted((r.place, r.size) for r in made.select("place", F.octet_length("features").alias("size")).collect())
    total = np.cumsum([size for _, size in sizes])
    # the hash is the id's: rows of one id stay or go together
    fits = int(np.searchsorted(total, most, side="right"))
    last = sizes[fits][0] if fits < len(sizes) else None
    got = (made if last is None else made.where(F.col("place") < last)).toArrow()
    return in_order(got)


def in_order(got: pa.Table) -> list[tuple[int, np.ndarray]]:
    """Rows ``label, place, features`` by place, label and features; the arrays are views of the table's own buffers."""
    label, place = got.column("label").to_pylist(), got.column("place").to_pylist()
    # of a blob its buffer's address, no copy
    rows = [np.frombuffer(x.as_buffer(), "<i4") for x in got.column("features")]
    order = sorted(range(len(rows)), key=lambda k: (place[k], label[k]))
    out = []
    for _, same in groupby(order, key=lambda k: (place[k], label[k])):
        ties = list(same)
        out += sorted(ties, key=lambda k: rows[k].tobytes()) if len(ties) > 1 else ties
    return [(label[k], rows[k]) for k in out]
