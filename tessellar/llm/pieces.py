"""Encoding and decoding with a merge-type SentencePiece model, by backtracking.

A text becomes ids without a queue of merges. From left to right the longest
piece that begins at a place is tried first, then its shorter beginnings; a
piece is taken if merging it and the piece before it anew leaves the two as they
are, and where none can follow, the place is marked as failed in a bitfield and
the piece before it is given up. A sequence whose neighbours all stand that test
is the one that the merges make: the first merge across a border of it would also
be the first across that border in the two pieces alone.

The longest pieces come from an Aho-Corasick automaton of the reversed pieces,
run over the reversed text: the longest match that ends at a place there begins
at it here. Where no piece holds a space after another character, such places
are borders of every encoding, and so are those between characters that no chain
of neighbours in pieces joins (letters and points, say). What lies between
borders ("units") is kept in a memo. Units that aren't in it are searched many
at a time, side by side in arrays; long ones, the last few, and those where a
character that is no piece stands alone are searched one by one.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship

SPACE = "▁"
#: Units and pairs in a worker's memos, which are begun anew when full; longer units (62 at most, a bit each place) aren't kept.
MEMO, LONGEST = 500_000, 48
#: Code points whose units are listed at a time, and code points of texts that a result batch has (or one longer text).
CHUNK, BATCH = 1 << 19, 1 << 19
#: So few units are searched one by one.
FEW = 32
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NONE, ALONE = -1, -2


class Pieces:
    """The ids of texts under the model in a file.

    Takes models of merge type with an identity normalizer, byte fallback and
    pieces that are normal, unknown, control or bytes only; others raise a
    ValueError.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm, trained = model.normalizer_spec, model.trainer_spec
        plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        if trained.model_type != 2 or not trained.byte_fallback or trained.treat_whitespace_as_suffix or not plain or any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in model.pieces):
            raise ValueError(f"{path} isn't a merge-type model with an identity normalizer and byte fallback")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        #: Pieces by text; their scores: the higher is merged first.
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:-1], 16): k for k, p in enumerate(model.pieces) if p.type == BYTE}
        # a piece that merging its own characters doesn't make is in no encoding
        whole = [piece for piece in self.ids if self.merged(piece) == [piece]]
        reachable = set(whole)
        self.text: list[str] = whole
        number = {piece: k for k, piece in enumerate(whole)}
        #: What to try after each reachable piece: its longest shorter beginning that is one too, else its first character; after that (NONE, ALONE as places from the end) nothing.
        shorter = (next((number[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in reachable), ALONE if piece[0] not in self.ids else NONE) for piece in whole)
        self.after = [*shorter, NONE, NONE]
        self.automaton = ahocorasick.Automaton()
        for piece, k in number.items():
            self.automaton.add_word(piece[::-1], k)
        self.automaton.make_automaton()
        #: The reachable pieces of one character by code point, and an automaton of the others.
        self.single = np.full(sys.maxunicode + 1, ALONE, np.int32)
        self.longer = ahocorasick.Automaton()
        for piece, k in number.items():
            if len(piece) == 1:
                self.single[ord(piece)] = k
            else:
                self.longer.add_word(piece[::-1], k)
        self.longer.make_automaton()
        #: Of the reachable pieces, then of ALONE and NONE: their lengths, what to try after them, their ids.
        self.lengths = np.array([*map(len, whole), 1, 0], np.int64)
        self.shorter = np.array(self.after, np.int64)
        self.numbers = np.array([*map(self.ids.get, whole), -1, -1], np.int32)
        #: Pairs of pieces met side by side, as left * len(text) + right, rising, and whether they stand the test.
        self.met, self.stand = np.zeros(0, np.int64), np.zeros(0, bool)
        #: A character of no piece.
        held = set(chain.from_iterable(self.ids))
        self.gap = next(c for c in map(chr, range(len(held) + 1)) if c not in held)
        within = any(SPACE in piece.lstrip(SPACE) for piece in self.ids)
        #: A space after another character begins a unit, unless some piece spans such a place; so does a character that isn't of the class of the one before.
        self.units = None if within else _units(self.ids)
        self.border = None if within else re.compile(f"(?<=[^{SPACE}]){SPACE}")
        self.memo: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """A short text by merges: of all neighbours whose union is a piece the one with the highest score, leftmost of equal ones, until none is."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _agree(self, left: str, right: str) -> bool:
        """Whether merging the two anew leaves the border between them; kept in a memo."""
        if len(self.pairs) >= MEMO:
            self.pairs.clear()
        got = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return got

    def unit(self, text: str) -> list[str]:
        """The pieces of a text between two borders; a character that isn't a piece stands alone."""
        n = len(text)
        longest = array("i", [ALONE]) * n
        last = -1
        for end, k in self.automaton.iter(text[::-1]):
            if end != last:  # the longest comes first
                longest[n - 1 - end] = k
                last = end
        failed = bytearray(n // 8 + 1)
        names, after, pairs = self.text, self.after, self.pairs
        out: list[str] = []
        taken: list[int] = []
        at, before = 0, None
        # of a place the numbers of pieces to try, falling in length, then ALONE if its character is none, then NONE
        trying = longest[0] if n else NONE
        while at < n:
            while trying != NONE:
                piece = names[trying] if trying >= 0 else text[at]
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    agree = before is None or pairs.get((before, piece))
                    if agree is None:
                        agree = self._agree(before, piece)
                    if agree:
                        break
                trying = after[trying]
            if trying != NONE:
                out.append(piece)
                taken.append(trying)
                at, before = end, piece
                trying = longest[at] if at < n else NONE
                continue
            failed[at >> 3] |= 1 << (at & 7)
            # the piece before this place is given up for a shorter one; there is one to give up, as some sequence stands the test
            at -= len(out.pop())
            before = out[-1] if out else None
            trying = after[taken.pop()]
        return out

    def _numbers(self, pieces: list[str]) -> array:
        out = array("i")
        for piece in pieces:
            k = self.ids.get(piece)
            if k is not None:
                out.append(k)
            else:
                out.extend(self.bytes[b] for b in piece.encode())
        return out

    def _longest(self, text: str) -> np.ndarray:
        """The longest reachable piece that begins at each place of a text, ALONE if none does."""
        back = text[::-1]
        longest = array("i", self.single[np.frombuffer(back.encode("utf-32-le", "surrogatepass"), np.uint32)].tobytes())
        last = -1
        for end, k in self.longer.iter(back):
            if end != last:  # the longest comes first
                longest[end] = k
                last = end
        return np.frombuffer(longest, np.int32)[::-1].astype(np.int64)

    def _stand(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pairs of pieces stand the test; new ones are kept."""
        keys = left.astype(np.int64) * len(self.text) + right
        at = np.searchsorted(self.met, keys)
        new = np.ones(len(keys), bool)
        within = at < len(self.met)
        new[within] = self.met[at[within]] != keys[within]
        if new.any():
            more = np.unique(keys[new])
            test = [self.merged(a + b) == [a, b] for a, b in ((self.text[x], self.text[y]) for x, y in zip(*(z.tolist() for z in np.divmod(more, len(self.text))), strict=True))]
            if len(self.met) + len(more) > MEMO:
                # those of this call stay, also if they were met before
                at = np.unique(at[~new])
                self.met, self.stand = self.met[at], self.stand[at]
            where = np.searchsorted(self.met, more)
            self.met, self.stand = np.insert(self.met, where, more), np.insert(self.stand, where, test)
            at = np.searchsorted(self.met, keys)
        return self.stand[at]

    def _together(self, units: list[str]) -> list[bytes | None]:
        """The ids of many short units, a step in all of them at a time; None where a character is no piece or few units are left."""
        longest = self._longest(self.gap.join([*units, ""]))
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        starts = np.cumsum(sizes + 1) - sizes - 1
        taken = np.zeros((len(units), int(sizes.max())), np.int32)
        counts, lost = np.zeros(len(units), np.int64), np.zeros(len(units), bool)
        lane, at, count, trying = np.arange(len(units)), np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), longest[starts]
        failed = np.zeros(len(units), np.int64)  # a bit for each place
        while True:
            # out of pieces to try: the place has failed, and the piece before it is given up for a shorter one
            back = np.flatnonzero(trying == NONE)
            failed[back] |= 1 << at[back]
            count[back] -= 1
            piece = taken[lane[back], count[back]]
            at[back] -= self.lengths[piece]
            trying[back] = self.shorter[piece]
            done = at == sizes[lane]
            none = ~done & (trying == ALONE)
            if done.any() or none.any():
                counts[lane[done]] = count[done]
                lost[lane[none]] = True
                lane, at, count, trying, failed = (x[~(done | none)] for x in (lane, at, count, trying, failed))
            if len(lane) <= FEW:
                lost[lane] = True
                break
            end = at + self.lengths[trying]
            agree = failed >> end & 1 == 0
            agree &= trying >= 0
            test = np.flatnonzero(agree & (count > 0))
            agree[test] = self._stand(taken[lane[test], count[test] - 1], trying[test])
            go, stay = np.flatnonzero(agree), np.flatnonzero(~agree)
            taken[lane[go], count[go]] = trying[go]
            count[go] += 1
            at[go] = end[go]
            trying[go] = longest[starts[lane[go]] + end[go]]
            trying[stay] = self.shorter[trying[stay]]
        ids = self.numbers[taken[np.arange(taken.shape[1]) < counts[:, None]]].tobytes()
        return [None if gone else ids[a:b] for (a, b), gone in zip(pairwise([0, *(4 * np.cumsum(counts)).tolist()]), lost.tolist(), strict=True)]

    def _search(self, units: list[str]) -> list[bytes]:
        """The ids of units."""
        short = [unit for unit in units if len(unit) <= LONGEST]
        found = dict(zip(short, self._together(short), strict=True)) if len(short) > FEW else {}
        return [self._numbers(self.unit(unit)).tobytes() if (ids := found.get(unit)) is None else ids for unit in units]

    def _parts(self, texts: list[str]) -> Iterator[list[tuple[int, str]]]:
        """Texts and their places, cut at borders and put together to some CHUNK code points."""
        part, held = [], 0
        for k, text in enumerate(texts):
            if not text:
                continue
            text, begin = self.prefix + text.replace(" ", SPACE), 0
            while begin < len(text):
                cut = self.border.search(text, begin + CHUNK) if len(text) - begin > CHUNK else None
                end = cut.start() if cut else len(text)
                part.append((k, text[begin:end]))
                held += end - begin
                begin = end
                if held >= CHUNK:
                    yield part
                    part, held = [], 0
        yield part

    def encode_all(self, texts: list[str]) -> list[array]:
        """The ids of texts, without begin or end ids; none for an empty text."""
        out = [array("i") for _ in texts]
        if self.units is None:
            return [self._numbers(self.unit(self.prefix + text.replace(" ", SPACE))) if text else ids for text, ids in zip(texts, out, strict=True)]
        memo = self.memo
        for part in self._parts(texts):
            units = [self.units.findall(text) for _, text in part]
            known = {unit: memo.get(unit) for unit in set().union(*units)}
            new = [unit for unit, ids in known.items() if ids is None]
            known.update(zip(new, self._search(new), strict=True))
            if len(memo) + len(new) > MEMO:
                memo.clear()
            memo.update((unit, known[unit]) for unit in new if len(unit) <= LONGEST)
            for (k, _), x in zip(part, units, strict=True):
                out[k].frombytes(b"".join(map(known.__getitem__, x)))
        return out

    def encode(self, text: str) -> array:
        """The ids of one text."""
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def _units(names: Iterable[str]) -> re.Pattern:
    """What stands between borders: spaces and after them characters of one class, or one character of none.

    Classes are the smallest ones that neighbours in pieces, other than spaces, share.
    """
    classes: dict[str, set[str]] = {}
    for a, b in {piece[k : k + 2] for piece in names for k in range(len(piece) - 1) if piece[k] != SPACE}:
        one, other = sorted((classes.setdefault(a, {a}), classes.setdefault(b, {b})), key=len)
        if one is not other:
            other |= one
            classes.update(dict.fromkeys(one, other))
    distinct = sorted({id(x): x for x in classes.values()}.values(), key=lambda x: (-len(x), min(x)))
    sets = ["".join(map(re.escape, sorted(x))) for x in distinct]
    return re.compile(f"{SPACE}*+(?:{''.join(f'[{x}]++|' for x in sets)}[^{SPACE}{''.join(sets)}])|{SPACE}+")


@cache
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def _path(model: str | None) -> str:
    if model is None:
        import public_tokenizers

        return public_tokenizers.path("piece_bpe_32k.model")
    return model


def _encoder(model: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        keys, texts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            ids = pieces.encode_all(texts)
            offsets = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x, np.int32) for x in ids)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            names, arrays = ["id", "ids"], [pa.array(keys, pa.int64()), lists]
            if decoded:
                names.append("decoded")
                arrays.append(pa.array([pieces.decode(x.tolist()) for x in ids], pa.string()))
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                keys.append(key.as_py())
                texts.append(text)
                held += len(text) + 1
                if held >= BATCH:
                    yield flush()
                    keys, texts, held = [], [], 0
        yield flush()

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, decoded: bool = False) -> DataFrame:
    """One row per document: ``id_col, ids`` (and ``decoded``), in one pass without a shuffle.

    ``ids`` equal the library's without begin and end ids; ``decoded`` is what
    the library makes of them. A null text counts as empty and has no ids;
    repeated rows and null ids are kept. Other columns aren't read; an empty
    table gives an empty result. In memory at a time are the texts and ids of
    some half a million code points, or one longer text's: four bytes for each
    of its ids and the same while one of its units is searched.
    """
    ship(docs.sparkSession)
    schema = "id bigint, ids array<int>" + (", decoded string" if decoded else "")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encoder(_path(model), decoded), schema).withColumnRenamed("id", id_col)


def _decoder(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            texts = (pieces.decode([k for k in ids.as_py() or [] if k is not None]) for ids in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "decoded"])

    return run


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """``id_col, decoded`` of every row's ids. Null ids count as none, a null among them is passed over; no ids give an empty text."""
    ship(rows.sparkSession)
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return own.mapInArrow(_decoder(_path(model)), "id bigint, decoded string").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` of encoded and decoded rows."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
