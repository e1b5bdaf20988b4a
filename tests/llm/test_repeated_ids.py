"""Stages that drop or repeat rows: texts of no id, or of an id that other texts have too, each decided on its own."""

from collections import Counter

from tessellar.llm import exactdup, mixing, neardup

SCHEMA = "doc_id bigint, text string, source string"


def _texts(frame):
    return Counter((r.doc_id, r.text) for r in frame.collect())


def test_exact_dedup_keeps_one_row_a_text(spark):
    rows = [(None, "a a", "s"), (None, "b b", "s"), (None, "b b", "s"), (1, "c c", "s"), (1, "d d", "s"), (1, "d d", "s"), (2, "e e", "s"), (2, "f f", "s"), (3, "f f", "s")]
    got = _texts(exactdup.drop_exact_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert got == Counter([(None, "a a"), (None, "b b"), (1, "c c"), (1, "d d"), (2, "e e"), (3, "f f")])


def _words(name, changed=()):
    return " ".join(f"{name}{k}{'x' if k in changed else ''}" for k in range(100))


def test_near_dedup_by_row(spark):
    # id 5 has two texts: one near that of 4, one near that of 9; id 7's second text is like no other
    rows = [(4, _words("a"), "s"), (5, _words("a", (50,)), "s"), (5, _words("b"), "s"), (9, _words("b", (50,)), "s"), (7, _words("a", (3,)), "s"), (7, _words("c"), "s"), (None, _words("a"), "s"), (None, _words("b"), "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == [(0, 0, True), (0, 0, True), (4, 4, True), (5, 4, False), (5, 5, True), (7, 4, False), (7, 7, True), (9, 5, False)]
    assert _texts(neardup.drop_near_duplicates(docs)) == Counter([rows[k][:2] for k in (0, 2, 5, 6, 7)])


def test_mix_by_row(spark):
    rows = [(None, "w " * n, "s") for n in range(1, 30)] + [(k // 3, "w " * (k + 1), "tu"[k % 2]) for k in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = Counter()
    for r in mixing.mix(docs, share=0.5).collect():
        want[r.doc_id, r["size"], r.source] += r.copies
    got = Counter((r.doc_id, r.text.count("w"), r.source) for r in mixing.mixed_documents(docs, share=0.5).collect())
    assert got == +want
