"""Backtracking encoder against the library: random texts, long units, odd rows; and against merges of its own for small vocabularies."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessellar.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(MODEL)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcdehilnorstTHE  ▁<s>0x09'-\n\té漢字🙂\x00ñ.,"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_equal_the_librarys(text):
    model = pieces._pieces(MODEL)
    ids = model.encode(text).tolist()
    assert ids == model.library.encode(text)
    assert model.decode(ids) == model.library.decode(ids)


@pytest.mark.parametrize("text", ["a" * 30000, " " * 30000, "ab" * 20000, "漢字" * 20000, "▁ ▁" * 9000, "".join(random.Random(1).choices("abcdefghijklmnop0123456789ABCDEF/+", k=60000)), "word and other words " * 80000])
def test_long_texts(model, text):
    assert model.encode(text).tolist() == model.library.encode(text)


def test_chunks_end_at_borders(model, monkeypatch):
    text = "several  words   with    runs of spaces and some more of them " * 20
    monkeypatch.setattr(pieces, "CHUNK", 7)
    assert model.encode(text).tolist() == model.library.encode(text)


class _Small(pieces.Pieces):
    """A vocabulary given by its pieces in the order of their merging."""

    def __init__(self, names):
        import ahocorasick

        self.ids = {name: k for k, name in enumerate(names)}
        self.scores = {name: -k for k, name in enumerate(names)}
        self.text = [name for name in names if self.merged(name) == [name]]
        number = {name: k for k, name in enumerate(self.text)}
        shorter = (next((number[name[:k]] for k in range(len(name) - 1, 0, -1) if name[:k] in number), pieces.NONE if name[0] in self.ids else pieces.ALONE) for name in self.text)
        self.after = [*shorter, pieces.NONE, pieces.NONE]
        self.automaton = ahocorasick.Automaton()
        for name, k in number.items():
            self.automaton.add_word(name[::-1], k)
        self.automaton.make_automaton()
        self.pairs = {}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=25, unique=True), st.text("abc", max_size=40))
def test_backtracking_equals_merging(names, text):
    """Also where characters aren't pieces and where the longest pieces fail."""
    small = _Small(names)
    if small.text:
        assert small.unit(text) == small.merged(text)


def test_rows(spark, model):
    long = "alpha beta  gamma " * 60000
    rows = [(1, "Hello  wörld 🙂"), (2, None), (3, ""), (4, long), (5, "same"), (5, "same"), (None, "null id"), (6, " lead and trail ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({k: F.lit(7) for k in ("id", "ids", "decoded", "n_tokens")})
    encoded = pieces.encode(docs, decoded=True)
    assert encoded.columns == ["doc_id", "ids", "decoded"]
    got = sorted(((r.doc_id, list(r.ids), r.decoded) for r in encoded.collect()), key=str)
    want = [(k, model.library.encode(t or ""), model.library.decode(model.library.encode(t or ""))) for k, t in rows]
    assert got == sorted(want, key=str)
    again = sorted(((r.doc_id, r.decoded) for r in pieces.decode(encoded).collect()), key=str)
    assert again == sorted(((k, t) for k, _, t in want), key=str)
    found = {r.doc_id: r for r in pieces.digests(encoded).collect()}
    assert found[1].n_tokens == len(want[0][1]) and found[1].ids_sha256 == hashlib.sha256(",".join(map(str, want[0][1])).encode()).hexdigest()
    assert found[2].n_tokens == 0 and found[2].ids_sha256 == found[3].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 450])], "doc_id bigint, ids array<int>")
    assert [r.decoded for r in pieces.decode(odd).orderBy("doc_id").collect()] == ["", "", model.library.decode([450])]
    empty = pieces.encode(docs.limit(0), decoded=True)
    assert pieces.digests(empty).count() == 0 == pieces.decode(empty).count()


def test_batches_of_large_texts(spark, model, monkeypatch):
    monkeypatch.setattr(pieces, "BATCH", 50)
    import pyarrow as pa

    run = pieces._encoder(MODEL, True)
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["some words of a text " * k for k in range(9)])], ["id", "text"])
    out = list(run(iter([batch, batch])))
    assert len(out) > 5 and [x for b in out for x in b.column(1).to_pylist()] == 2 * [model.library.encode("some words of a text " * k) for k in range(9)]


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Pieces(str(tmp_path / "other.model"))


def _syllables(seed, words, alphabet=("th", "er", "on", "ing", "ti", "Ae", "és", "ña", "gh", "sch", "0", "\n", ".", "&&", "漢", "д", "🙂")):
    rng = random.Random(seed)
    return [" " * rng.choice((0, 1, 1, 2)) + "".join(rng.choices(alphabet, k=rng.randint(1, 9))) for _ in range(words)]


def test_new_words_are_searched_together(monkeypatch):
    """Words that no memo has took a search of their own each."""
    model, alone = pieces.Pieces(MODEL), []
    search = model.unit
    monkeypatch.setattr(model, "unit", lambda text: alone.append(text) or search(text))
    text = "".join(_syllables(1, 5000))
    assert model.encode(text).tolist() == model.library.encode(text)
    assert len(model.memo) > 2000 and len(alone) < 200


@pytest.mark.parametrize("few", [0, 32])
def test_texts_together(monkeypatch, few):
    """Few units left, memos that are full at once, parts that begin anywhere; texts with characters of no piece, long units, none at all."""
    model = pieces.Pieces(MODEL)
    texts = ["".join(_syllables(k, 40)) for k in range(60)] + ["", "\x00 \x00a", "a" * 100, "", "▁▁ ▁x"] + ["".join(_syllables(k, 60, "aehinorst")) for k in range(20)]
    want = [model.library.encode(text) for text in texts]
    monkeypatch.setattr(pieces, "FEW", few)
    assert [ids.tolist() for ids in model.encode_all(texts)] == want
    monkeypatch.setattr(pieces, "MEMO", 50)
    monkeypatch.setattr(pieces, "CHUNK", 300)
    for _ in range(2):
        assert [ids.tolist() for ids in model.encode_all(texts)] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc▁", min_size=1, max_size=4), max_size=12), st.text("abcd▁", max_size=30))
def test_no_piece_spans_a_border(names, text):
    if any("▁" in name.lstrip("▁") for name in names):
        return
    cut = pieces._units(names).findall(text)
    assert "".join(cut) == text
    spans = {name[k : k + 2] for name in names for k in range(len(name) - 1)}
    assert not any(a[-1] + b[0] in spans for a, b in zip(cut, cut[1:], strict=False))
