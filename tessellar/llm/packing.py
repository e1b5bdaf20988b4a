"""Packing token sequences of documents into windows by Karmarkar-Karp differencing.

A document's ids are cut at multiples of the window; full windows stand alone.
The remainder is cut at multiples of PIECE. The remainders' pieces of a block of documents are dealt to m windows by multiway
differencing: every piece starts as a partial partition (one subset, the
others empty); the two partial partitions with the largest imbalance are merged
with their subsets in opposing order until one is left, whose m sums are nearly
equal. m starts at the least that could hold the block, and rises while the
largest sum is over the capacity.

Tokens never leave the task that made them: a block is a run of rows of one
partition, so packing needs no shuffle at any input size.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship

WINDOW = 2048
#: What is left of a document after its full windows is cut at multiples of this, so that
#: windows of several pieces come out nearly equal (without, they'd be 2 to 3 % padding).
PIECE = 512
#: Pieces that are packed together.
BLOCK = 8192
#: Words in the memo of a worker, which is begun anew after eight times as many misses.
MEMO = 150_000
END = 1


def differencing(sizes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiway Karmarkar-Karp: the subset (0 to m - 1) of each item, and the subsets' sums.

    A partial partition is kept as its non-empty subsets in falling order of
    sums, as an offset (what all m subsets have) is of no account for the
    imbalance but is for the sums.
    """
    n = len(sizes)
    subset = np.arange(n)  # of each item the node of a forest whose roots are subsets
    parent = list(range(n))
    # imbalance, order of making, sums in falling order (length m or shorter, then zeros), roots
    heap = [(-int(x), k, np.array([x], np.int64), np.array([k])) for k, x in enumerate(sizes)]
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        _, _, a, ra = heapq.heappop(heap)
        _, _, b, rb = heapq.heappop(heap)
        if len(a) + len(b) <= m:
            sums, roots = np.concatenate([a, b]), np.concatenate([ra, rb])
        else:
            # largest of one with smallest of the other; the subsets that are missing are empty ones
            meet = len(a) + len(b) - m
            joined = a[len(a) - meet :] + b[len(b) - meet :][::-1]
            for x, y in zip(ra[len(a) - meet :], rb[len(b) - meet :][::-1], strict=True):
                parent[y] = x
            sums = np.concatenate([a[: len(a) - meet], b[: len(b) - meet], joined])
            roots = np.concatenate([ra[: len(a) - meet], rb[: len(b) - meet], ra[len(a) - meet :]])
        order = np.argsort(-sums, kind="stable")
        sums, roots = sums[order], roots[order]
        spread = int(sums[0]) - (int(sums[-1]) if len(sums) == m else 0)
        heapq.heappush(heap, (-spread, made, sums, roots))
        made += 1
    _, _, sums, roots = heap[0]
    number = {int(r): k for k, r in enumerate(roots)}
    for k in range(n):
        r = k
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        subset[k] = number[r]
    return subset, np.concatenate([sums, np.zeros(m - len(sums), np.int64)])


def windows(sizes: np.ndarray, capacity: int = WINDOW) -> np.ndarray:
    """The window of each item; no window is over ``capacity`` (items aren't either)."""
    m = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        subset, sums = differencing(sizes, m)
        if sums.max(initial=0) <= capacity:
            return subset
        m = max(m + 1, int(m * int(sums.max()) / capacity))


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _ordinary(path: str):
    """The same vocabulary as ranks, for text without special tokens: several times as fast on single words."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary, encoding._core_bpe.encode_single_piece


#: White space other than the space, next to which a space isn't a word's own.
_ODD = re.compile(r"^ | $|  |[^\S ] | [^\S ]|[\x1c-\x1f]")


class Ids:
    """Ids of texts as little-endian 32-bit bytes: those of the tokenizer in the JSON file.

    Byte-level pre-tokenization never spans a single space between two
    characters that aren't white space (the space opens the next word), so a
    text's ids are those of its words joined, and a memo of words saves most of
    the work. A text with other white space next to a space, or with a special
    token, is encoded whole.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            self.special = [x["content"] for x in json.load(file).get("added_tokens") or []]
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            self.ordinary, self.piece = _ordinary(ranks)
        else:
            self.ordinary = lambda x: _tokenizer(path).encode(x, add_special_tokens=False).ids
            self.piece = lambda x: self.ordinary(x.decode())
        self.memo: dict[str, bytes] = {}
        self.missed = 0

    def _word(self, word: str) -> bytes:
        """The ids of a word with the space before it."""
        if word.isalpha():  # one piece of the pre-tokenizer
            ids = self.piece(f" {word}".encode())
        elif word[:-1].isalpha() and word[-1] in ".,!?:;":
            ids = self.piece(f" {word[:-1]}".encode()) + self.piece(word[-1].encode())
        else:
            ids = self.ordinary(f" {word}")
        return array("I", ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            # loaded only where a text needs it
            return array("I", _tokenizer(self.path).encode(text, add_special_tokens=False).ids).tobytes()
        if _ODD.search(text):
            return array("I", self.ordinary(text)).tobytes()
        first, *rest = text.split(" ")
        parts = list(map(self.memo.get, rest))
        if None in parts:
            memo, encode = self.memo, self._word
            if self.missed > 8 * MEMO:
                memo.clear()
                self.missed = 0
            for k, got in enumerate(parts):
                if got is None:
                    word = rest[k]
                    parts[k] = got = encode(word)
                    self.missed += 1
                    if len(memo) < MEMO and len(word) < 40:
                        memo[word] = got
        return array("I", self.ordinary(first)).tobytes() + b"".join(parts)


_ids: dict[str, Ids] = {}

SCHEMA = "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _packer(path: str, window: int, block: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _ids.setdefault(path, Ids(path))
        base = TaskContext.get().partitionId() << 40
        made = 0
        rows: list[tuple] = []  # id, start, length, crc, tokens, sequence or None, offset, ids
        open_rows: list[int] = []
        end = np.array([END], "<u4").tobytes()

        def flush():
            nonlocal made, rows, open_rows
            if open_rows:
                sizes = np.array([rows[k][2] for k in open_rows], np.int64)
                seat = windows(sizes, window)
                at = np.zeros(seat.max() + 1, np.int64)
                for k, w, size in zip(open_rows, seat, sizes, strict=True):
                    rows[k] = (*rows[k][:5], base + made + int(w), int(at[w]), rows[k][7])
                    at[w] += size
                made += len(at)
            cols = list(zip(*rows, strict=True)) or [()] * 8
            rows, open_rows = [], []
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            if with_ids:
                names.append("ids")
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names)

        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                tokens = len(ids) // 4
                whole = tokens - tokens % window
                for start in [*range(0, whole, window), *range(whole, tokens, PIECE)]:
                    piece = ids[4 * start : 4 * (start + (window if start < whole else PIECE))]
                    length = len(piece) // 4
                    full = length == window
                    rows.append((doc, start, length, zlib.crc32(piece), tokens, base + made if full else None, 0, piece if with_ids else None))
                    made += full
                    if not full:
                        open_rows.append(len(rows) - 1)
                    held += length
                    if len(open_rows) >= block or len(rows) >= 8 * block:
                        yield flush()
                        held = 0
        yield flush()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, block: int = BLOCK, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    A document's ids are the tokenizer's and a closing ``END``; a null or empty
    text is that id alone. Rows are packed as they come: repeated rows and
    ids are separate documents, a null id stays null. Sequence ids hold the
    partition in their upper bits, so they are unique but not gapless, and the
    same again when a lost task is run again on the same partition. A
    sequence's length that is a power of two isn't padded; any other is padded
    to ``window``. An empty table gives an empty result.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    ship(docs.sparkSession)
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_packer(tokenizer, window, block, with_ids), schema)
    return out.withColumnRenamed("id", id_col)
