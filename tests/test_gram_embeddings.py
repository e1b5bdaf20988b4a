"""Gram matrices of embeddings against their SQL, on rows that are easily rounded, joined or counted otherwise."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from tessellar.jobs import queries

HALF = [0.0005, 0.0025, 0.0035, -0.0145, 0.0125, 0.0985]  # a half in thousandths by single precision; a little more or less by double


def both(spark, path, rows):
    ids, vectors, labels = zip(*rows, strict=True)
    types = (pa.int64(), pa.list_(pa.float32()), pa.int32())
    columns = [pa.array(c, t) for c, t in zip((ids, vectors, labels), types, strict=True)]
    pq.write_table(pa.table(columns, ["vec_id", "embedding", "label"]), path / "embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path / 'embeddings.parquet'}'")
    want = db.execute(__spark_entry__.oracle_sql()["gram_embeddings"]).fetchall()
    got = __spark_entry__.queries()["gram_embeddings"](spark, str(path))
    assert got.dtypes == [("label", "int"), ("a", "int"), ("b", "int"), ("g", "bigint")]
    return sorted(map(tuple, got.collect()), key=str), sorted(want, key=str)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_halves_are_rounded_in_single_precision(spark, tmp_path, ansi):
    x = np.array(HALF, "f4")
    assert ((x.astype(float) * 1000 % 1 < 0.5) & (x * np.float32(1000) % 1 == 0.5)).any()
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        got, want = both(spark, tmp_path, [(k, [v, 1.0], k % 2) for k, v in enumerate(HALF)])
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert got == want and len(got) == 8


@pytest.mark.parametrize("most", [10_000, 0])
def test_rows_of_one_id_are_one_vector(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(queries, "BROADCAST_KEYS", most, raising=False)
    rows = [(1, [0.5, 2.0], 0), (1, [1.0, -3.0, 4.0], 0), (1, [7.0, 1.0], 1), (2, [0.25, 1.0], 0), (3, [], 1), (3, [1.0], 1), (3, None, 1), (1, [0.125], 0)]
    got, want = both(spark, tmp_path, rows)
    assert got == want and len(got) == 9 + 4


def test_rows_of_no_id_or_label_and_missing_components(spark, tmp_path):
    rows = [(None, [1.0, 2.0], 0), (None, [5.0, 2.0], 0), (1, [3.0, 1.0], None), (2, [1.0, None], 0), (2, [None, 2.0], 0), (3, [None, 4.0], 1), (4, None, 1)]
    got, want = both(spark, tmp_path, rows)
    assert got == want and [r for r in got if r[3] is None] == [(1, 0, 0, None), (1, 0, 1, None), (1, 1, 0, None)]
