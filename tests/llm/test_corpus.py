"""Every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; and brute force."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessellar.llm import exactdup, html_extract, licenses, media, mixing, neardup, packing, quality, secrets, toxicity
from tessellar.llm.words import slices

LONG = "alpha beta gamma delta " * 30000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog", "a"),
    (2, "THE quick brown fox jumps over the lazy dog", None),
    (3, None, None),
    (4, "", "b"),
    (5, LONG, "b"),
    (6, "one two", "a"),
    (6, "one two", "a"),
    (None, "one two", "a"),
    (7, "ünï çödé É é", "c"),
    (8, "Released under the MIT License. password = hunter22 idiot", "c"),
]
SCHEMA = "doc_id bigint, text string, source string"
#: Names that operators use inside.
EXTRA = ["id", "class", "row", "size", "copies", "draw", "label", "band", "component", "digest", "s", "w", "start"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({k: F.lit(7) for k in EXTRA})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (8, 0, 1), (6, None, None), (None, 1, 1), (99, 0, 1)], "doc_id bigint, quality int, toxic int")


def test_all_take_empty_tables(spark, none, labels):
    assert exactdup.exact_duplicates(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert packing.pack(none).count() == 0
    assert neardup.near_duplicates(none).count() == 0
    assert secrets.scan(none).count() == media.telephony(none).count() == licenses.scan(none).count() == 0
    for m in (quality, toxicity):
        assert m.score(none, m.train(none, labels)).count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_exact_duplicates(spark, docs):
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exactdup.exact_duplicates(docs).collect())
    assert got == [(0, 6, 3, False), (1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 3, True), (6, 6, 3, True), (7, 7, 1, True), (8, 8, 1, True)]
    assert sorted(r.doc_id for r in exactdup.drop_exact_duplicates(docs).collect()) == [2, 4, 5, 6, 7, 8]
    sha = {r.doc_id: r.text_sha256 for r in exactdup.exact_duplicates(docs).collect()}
    assert sha[7] == hashlib.sha256("ünï çödé É é".encode()).hexdigest()


def test_digest_index_over_batches(spark, docs):
    index = exactdup.DigestIndex(spark, "own_index", 4)
    batches = [[(1, "x"), (None, "n")], [(8, "x"), (9, "X"), (2, "q")], [(4, "q"), (None, "z"), (3, "n")], []]
    seen = {}
    for k, rows in enumerate(batches):
        index.append(exactdup.digests(spark.createDataFrame(rows, "doc_id bigint, text string")))
        for d, t in rows:
            seen.setdefault(t.lower(), []).append(d)
        want = sorted((max((d for d in v if d is not None), default=0), len(v)) for v in seen.values())
        assert sorted((r.keep_id or 0, r.group_size) for r in index.read().collect()) == want
        if k == 1:
            index.compact()
    assert spark.table(index.name).count() == spark.table(index.name).select("digest").distinct().count() == len(seen)
    # a table added to a kept index is judged by all of its batches
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exactdup.exact_duplicates(spark.createDataFrame([(5, "x"), (11, "Q")], "doc_id bigint, text string"), index="own_index").collect()}
    assert got == {(5, 9, 4, False), (11, 11, 3, True)}
    index.drop()
    before = len(spark.catalog.listTables())
    assert exactdup.exact_duplicates(docs, batches=3).count() == len(ROWS) and len(spark.catalog.listTables()) == before


def test_mix(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    total = sum(r["size"] for r in rows)
    targets = {r.source: r.target for r in rows}
    assert sum(targets.values()) == pytest.approx(total)
    assert all(r.taken <= 3 * r["size"] and r.target <= 3 * r.source_size for r in rows)
    assert {r.source: 0 for r in rows}.keys() == {"a", "b", "c", None}
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.xxhash64("id") % 90 + 95).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    got = mixing.mix(many).groupBy("source").agg(F.max("target").alias("t"), F.sum("taken").alias("k")).collect()
    assert all(abs(r.k - r.t) <= max(2, 0.002 * r.t) for r in got)
    assert sorted(mixing.mix(many).collect()) == sorted(mixing.mix(many).collect())
    assert mixing.mixed_documents(many).columns == many.columns


def _onto(text):
    path = __import__("public_tokenizers").path("byte_bpe_50k.json")
    return packing._tokenizer(path).encode(text, add_special_tokens=False).ids


def test_pack(docs):
    pieces = packing.pack(docs, with_ids=True).collect()
    seats = {}
    for r in pieces:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        seats.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seats.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    for doc, text, _ in ROWS:
        if doc != 6 and doc is not None:
            ids = [x for r in sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start) for x in r.ids]
            assert ids == [*_onto(text or ""), 1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "  ", "\n", "\t", "it's", "é", "12", "!?", "Word,", "<|endoftext|>", "\xa0", " ", "\x1f", "don't.", "x" * 50]), max_size=12).map("".join))
def test_ids_are_the_tokenizers(text):
    encode = packing.Ids(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    assert np.frombuffer(encode(text), "<u4").tolist() == _onto(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 512), min_size=1, max_size=60))
def test_windows_hold_their_items(sizes):
    seat = packing.windows(np.array(sizes), 1024)
    assert np.bincount(seat, weights=sizes).max() <= 1024


def test_near_duplicates_against_brute_force(spark, docs):
    base = [f"w{k}" for k in range(120)]
    rows = list(ROWS)
    g = np.random.default_rng(3)
    for d in range(100, 180):
        words = list(base)
        for k in g.integers(0, 120, int(g.integers(0, 4))):
            words[k] = f"x{d}"
        rows.append((d, " ".join(words), "z"))
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), percent=85).collect()}
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for d, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets.append((d, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    least = {d: d for d, _ in sets}
    for _ in range(len(sets)):
        before = dict(least)
        for a, x in sets:
            for b, y in sets:
                if a is not None and b is not None and x and y and 100 * len(x & y) >= 85 * len(x | y):
                    least[a] = min(least[a], least[b])
        if before == least:
            break
    assert got == {(d, len(x), least[d], d is None or least[d] == d) for d, x in sets}


def test_shared_counts():
    g = np.random.default_rng(1)
    one, two = ([np.unique(g.integers(0, 60, 20)).astype(np.uint64) for _ in range(5)] for _ in range(2))
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in two] for x in one]
    assert neardup.shared_counts(one, two, columns=7).tolist() == want


def test_page_text(spark):
    html = """<html><head><title>no</title><script>var a='<p>no</p>'</script></head><body><nav><li>no<li>no</nav>
    <div class="cookie-notice">no</div><div class="sidebar"><p>no</p></div><main><h1>Head&amp;line</h1><p>One <b>t</b>wo<p>three&nbsp;four</p>
    <form>no</form><div class="comments"><p>no</p></div><p>five</p></main><footer>no</footer>"""
    pages = spark.createDataFrame([(1, "u", html), (2, None, None), (3, "u", ""), (None, "u", "<p>x"), (1, "u", html)], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.extract(pages).collect()]
    text = "Head&line One two three four five"
    assert sorted(got, key=str) == sorted([(1, text, len(text)), (2, "", 0), (3, "", 0), (None, "x", 1), (1, text, len(text))], key=str)


def _texts(spark, n=160):
    words = ["the", "of", "and", "an", "in", "tion", "ing"]
    g = np.random.default_rng(2)
    rows, marks = [], []
    for d in range(n):
        w = [str(x) for x in g.choice(words, 40)]
        bad, toxic = d % 4 == 0, d % 3 == 0
        if bad:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            w[int(g.integers(0, 40))] = "idiot."
        rows.append((d, " ".join(w), "a"))
        marks.append((d, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_held_out_rows(spark, docs, labels, module, label):
    texts, marks = _texts(spark)
    model = module.train(texts, marks)
    got = module.score(texts, model).join(marks, "doc_id").where("held_out").collect()
    assert got and all(r.predicted == r[label] for r in got) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert module.score(docs, module.train(docs, labels)).count() == len(ROWS)


def test_toxic_sentence_is_located():
    weights, order = np.zeros(1 << toxicity.BITS), np.zeros(1 << toxicity.BITS)
    s = next(slices(pa.array(["scum"])))
    weights[toxicity.sentence_words(s)[1][0, 0]], order[toxicity.sentence_words(s)[1][0, 0]] = 9, 1
    text = "é fine. you scum here! ok"
    row, start, end, p = toxicity.Model(weights, -4.0, order).sentences(next(slices(pa.array([text]))))
    data = text.encode()
    assert [data[a:b].decode() for a, b, x in zip(start, end, p, strict=True) if x > 0.5] == ["you scum here"]


def test_secrets(docs):
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    text = ROWS[9][1]
    at = text.index("password")
    assert got[8].spans.startswith(f"assign:{at}:{at + len('password = hunter22')}")
    assert got[3].spans == "" and got[8].n_assign == 1
    key = "Ab3dE5fG7hJ9kL1mN2pQ4rS6tU8vW0xY"
    weak = lambda t: [x[0] for x in secrets.linked(t, secrets.strong_spans(t), secrets.weak_spans(t))]
    assert weak(f"see {key} there") == []
    assert weak(f"user = bob and {key} at https://db.example.org/x") == ["identity", "endpoint", "key"]
    assert weak(f"user = bob {'x ' * 200} {key}") == []
    assert [x[0] for x in secrets.strong_spans("ſecret=abcdefgh AKIA" + "A" * 16 + " " + "0a" * 12)] == ["access", "hex"]


def test_media(docs):
    for r in media.telephony(docs).collect():
        text = next((t for d, t, _ in ROWS if d == r.doc_id), "")
        n, payload = media.payload_of(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (n, len(payload), hashlib.sha256(payload).hexdigest())
        assert len(payload) % media.UNIT == 0 and payload and r.tail_crc32 == zlib.crc32(payload[-32:])
    for form in (media.MULAW, media.ALAW, media.ADPCM):
        data = bytes(range(256)) * 9
        assert media.read(media.store(data, form))[2] == data
    assert media.MULAW_PCM[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert media.ALAW_PCM[[0xD5, 0x55, 0x2A, 0xAA]].tolist() == [8, -8, -32256, 32256]
    flat = np.zeros((2, media.BLOCK), np.uint8)
    assert media.adpcm_pcm(flat).shape == (2, 569) and not media.adpcm_pcm(flat).any()
    assert len(media.resample(np.arange(800, dtype=np.int16), 8000, 16000)) == 1600
    assert {len(r.pcm) > 44 for r in media.media_column(docs.limit(2)).collect()} == {True}


def test_licenses(spark, docs):
    grant = licenses.TEMPLATES["mit-grant"].split()
    near = " ".join(["x"] * 37 + grant[:20] + ["CHANGED"] + grant[21:] + ["y"] * 11)
    far = " ".join(grant[k] if k % 4 else "x" for k in range(len(grant)))
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(20, near), (21, far)], "doc_id bigint, text string"))
    got = [(r.doc_id, r.license) for r in licenses.scan(more).collect()]
    assert sorted(got) == [(8, "mit-notice"), (20, "mit-grant")]


def test_shingles_of_short_rows():
    s = next(slices(pa.array(["a b", "a b c d e", "", "a  b", None])))
    values, starts = neardup.sets(s)
    assert np.diff(starts).tolist() == [1, 1, 0, 1, 0] and values[0] == values[2]
