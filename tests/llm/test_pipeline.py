"""The pipeline's rows against a plain reading of every stage; the mix against its SQL on awkward rows."""

import re
import zlib
from collections import Counter
from hashlib import md5

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessellar.llm import mixing, quality
from tessellar.llm.queries import ORACLES
from tessellar.llm.store import table
from tessellar.llm.words import slices

SMALL = "/root/testdata/sf0.001"
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def exact(rows):
    last = {}
    for d, t, _ in rows:
        key = (t or "").translate(FOLD)
        last[key] = max(d, last.get(key, d))
    keep = set(last.values())
    return [x for x in rows if x[0] in keep]


def near(rows):
    sets = []
    for d, t, _ in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets.append((d, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    least = {d: d for d, _ in sets}
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    for _ in links:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return [x for x in rows if least[x[0]] == x[0]]


def mixed(rows):
    """Copies of each document: water filling, then every source's documents one after another by Pareto rank."""
    docs = [(d, s, len(WORD.findall(t or "")), int(md5(f"0:{d}".encode()).hexdigest()[:12], 16)) for d, t, s in rows]
    size, many = Counter(), Counter()
    for _, s, n, _ in docs:
        size[s] += n
        many[s] += n > 0
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full = float(sum(size.values())), set()
    while True:
        left = total - 3 * sum(size[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and left * weight[s] / share >= 3 * size[s]}
        if not over:
            break
        full |= over
    copies = {}
    for s in names:
        target = 3 * size[s] if s in full else left * weight[s] / share
        whole = int(target // size[s]) if size[s] else 0
        gap = target - whole * size[s]
        more = set()
        if gap > 0:
            p = gap / size[s]
            order = []
            for d, t, n, draw in docs:
                if t == s and n:
                    u = (draw + 0.5) / 2.0**48
                    q = u / (1 - u) / (p / (1 - p) * (n * many[s]) / size[s])
                    order.append((int(q / (1 + q) * 2.0**48), d, n))
            over = []
            for rank, d, n in sorted(order):
                if n <= gap:
                    gap -= n
                    more.add(d)
                else:
                    over.append((n, rank, d))
            near = [(abs(n - gap), rank, d) for n, rank, d in over if n < 2 * gap]
            if near:
                more.add(min(near)[2])
        copies |= {d: whole + (d in more) for d, t, _, _ in docs if t == s}
    return copies


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SMALL, "documents")
    model = quality.train(docs, table(spark, SMALL, "labels"))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    good = [x for x in rows if float(model.score(next(slices(pa.array([x[1] or ""], pa.string()))))[0]) >= 0.3]
    return rows, good


def test_pipeline_against_brute_force(spark, stages):
    rows, good = stages
    assert len(good) > len(rows) // 2
    kept = near(exact(good))
    assert len(kept) < len(good)
    copies = mixed(kept)
    texts = {d: t or "" for d, t, _ in kept}
    encode = __import__("tokenizers").Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json")).encode
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    by_doc, seats = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, Counter())[r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        seats.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == {d for d, n in copies.items() if n}
    for d, found in by_doc.items():
        ids = np.array([*encode(texts[d], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for start, length, crc, tokens in sorted(found):
            assert start == at and tokens == len(ids) and crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids) and set(found.values()) == {copies[d]}
    for s in seats.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_hand_on_documents(spark):
    docs = table(spark, SMALL, "documents").withColumn("text", F.when(F.col("doc_id") % 7 > 0, F.col("text"))).withColumn("source", F.when(F.col("doc_id") % 5 > 0, F.col("source")))
    none = docs.where("false")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert none.columns == docs.columns
        assert stage(spark, none, SMALL).count() == 0
        out = stage(spark, docs, SMALL)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        assert out.count() > 0


def test_mix_equals_its_sql(spark):
    g = np.random.default_rng(4)
    rows = [(int(d), " ".join(["w"] * int(n)), s) for d, n, s in zip(range(400), g.integers(0, 60, 400), g.choice(["a", "b", "é", "Z", ""], 400, p=[0.6, 0.2, 0.1, 0.06, 0.04]), strict=True)]
    rows += [(500, None, "a"), (501, "", "empty"), (502, "x y", None), (503, "x\x1fy z\tz", None), (504, "w " * 5000, "b"), (505, "w " * 40, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    documents = pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate([("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string())])})
    db = duckdb.connect()
    db.register("documents", documents)
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    want = sorted(db.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES['op3_mix_sources']})").fetchall())
    got = sorted(tuple(r[c] for c in cols) for r in mixing.mix(docs).collect())
    assert got == want


def test_mix_passes_over_what_does_not_fit(spark):
    rows = [(k, "w " * 100, "a") for k in range(800)] + [(900, "w " * 20000, "a")] + [(k, "w " * 7, "b") for k in range(1000, 1040)] + [(1100, "w " * 3000, "b"), (1101, "w w", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for r in mixing.mix(docs, share=0.31).groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 50


def test_mix_with_sources_joined_by_shuffle(spark):
    docs = table(spark, SMALL, "documents")
    sized = mixing._sized(docs, "doc_id", "text", "source", 0)
    few, many = (mixing._copies(sized, *mixing._plan(sized, (1, 2, 3), 1.0, 3, few=way)).select("id", "size", "copies") for way in (True, False))
    assert sorted(few.collect()) == sorted(many.collect())


def test_larger_documents_are_likelier(spark):
    rows = [(k, "w " * (10 if k % 2 else 40), "ab"[k % 4 > 1]) for k in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), weights=(1, 9), share=0.5).where("source = 'a'")
    by = {r["size"]: r.n for r in got.where("taken > 0").groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert by[40] > 2 * by[10] > 0
