"""Runs of equal keys stay whole however the batches are cut."""

import pyarrow as pa
import pytest

from tessellar.llm import neardup

from .test_hot_buckets import test_split_buckets_equal_all_pairs as all_pairs


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_runs_are_whole(size):
    keys = [(1, 0), (1, 0), (1, 1), (2, 1), (2, 1), (2, 1), (2, 1), (3, 0)]
    rows = pa.RecordBatch.from_arrays([pa.array([a for a, _ in keys]), pa.array([b for _, b in keys]), pa.array(range(len(keys)))], ["a", "b", "v"])
    parts = [rows.slice(k, size) for k in range(0, len(keys), size)] + [rows.slice(0, 0)]
    found = [batch.column("v").to_pylist()[x:y] for batch, at in neardup._runs(iter(parts), ("a", "b")) for x, y in zip(at[:-1], at[1:])]
    assert found == [[0, 1], [2], [3, 4, 5, 6], [7]]


def test_no_rows_no_runs():
    assert list(neardup._runs(iter([]), ("a",))) == []


def test_blocks_over_small_batches(spark, monkeypatch):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    monkeypatch.setattr(neardup, "REGISTER_BLOCK", 16)
    monkeypatch.setattr(neardup, "PAIRS", 30)
    try:
        all_pairs(spark, monkeypatch)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
