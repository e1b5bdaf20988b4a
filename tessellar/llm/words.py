"""Words of many texts at once, as numpy arrays over Arrow buffers.

A *slice* is a run of rows of an Arrow batch with at most ``SLICE_BYTES`` of
text (or a single longer row), so memory follows the longest text and never
the size of a batch or a partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
SLICE_ROWS = 4096
_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def _lut(of) -> np.ndarray:
    return np.array([of(b) for b in range(256)])


SPACE = _lut(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
#: Everything but ASCII letters, digits and bytes of other scripts.
NOT_CORE = _lut(lambda b: b < 0x80 and not chr(b).isalnum())
LOWER = _lut(lambda b: b + 32 if 65 <= b <= 90 else b).astype(np.uint8)
#: Upper, lower (with all other scripts), digit; any other byte stands for itself.
SHAPE = _lut(lambda b: 65 if 65 <= b <= 90 else 97 if b >= 0x80 or 97 <= b <= 122 else 48 if 48 <= b <= 57 else b).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = stream(1, 256)
_P = 0x2545F4914F6CDD1D
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    got = _powers.get(kind)
    if got is None or len(got) < n:
        size = max(n, SLICE_BYTES + 1)
        got = np.full(size, _P if kind == "p" else _PINV, dtype=np.uint64)
        got[0] = 1
        got = np.cumprod(got, dtype=np.uint64)
        if size <= 4 * SLICE_BYTES:  # arrays for a rare long text aren't kept
            _powers[kind] = got
    return got


def hash_spans(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``codes[start:end]`` for every span, in order of their starts: a polynomial by prefix sums.

    Of a long text the spans are taken some MB at a time, as the sums have 8
    bytes a byte; what is kept has 8 bytes a span.
    """
    if len(codes) > 2 * SLICE_BYTES and len(start) > 1:
        cuts = np.searchsorted(start, np.arange(int(start[0]) + SLICE_BYTES, int(start[-1]) + 1, SLICE_BYTES))
        edges = np.unique(np.concatenate([[0], cuts, [len(start)]]))
        return np.concatenate([_hash(codes[start[a] : end[a:b].max()], start[a:b] - start[a], end[a:b] - start[a]) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    return _hash(codes, start, end)


def _hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(codes)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[codes] * _power("p", n + 1)[:n], dtype=np.uint64, out=sums[1:])
    return mix((sums[end] - sums[start]) * _power("inv", n + 1)[start])


@dataclass
class Slice:
    first: int  #: row of the batch that the slice begins with
    rows: int
    data: np.ndarray  #: UTF-8 bytes of all rows
    offsets: np.ndarray  #: rows + 1 places in data


def slices(column: pa.Array) -> Iterator[Slice]:
    """Null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = int(np.searchsorted(offs, offs[a] + SLICE_BYTES, side="right")) - 1
        b = min(max(b, a + 1), a + SLICE_ROWS, len(column))
        yield Slice(a, b - a, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        a = b


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray  #: row of the slice


def words(s: Slice, separators: np.ndarray = SPACE) -> Words:
    n = len(s.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~separators[s.data]
    edge = np.zeros(n + 1, bool)
    edge[s.offsets] = True
    here = inside[1:-1]
    start = np.flatnonzero(here & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(here & (~inside[2:] | edge[1:])) + 1
    return Words(start, end, np.searchsorted(s.offsets, start, side="right") - 1)


def shingles(h: np.ndarray, row: np.ndarray, rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes (64 bits) of all rows, and where each row's begin.

    A row of fewer than ``size`` words has its whole sequence as the one
    shingle; a row without words has none.
    """
    coef = stream(2, size) | np.uint64(1)
    many = np.bincount(row, minlength=rows)
    value = np.zeros(0, np.uint64)
    of = np.zeros(0, np.int64)
    if len(h) >= size:
        same = row[size - 1 :] == row[: len(h) - size + 1]
        value = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            value += h[k : len(h) - size + 1 + k] * coef[k]
        value, of = mix(value[same]), row[: len(same)][same]
    short = np.flatnonzero((many > 0) & (many < size))
    if len(short):
        at = np.concatenate([[0], np.cumsum(many)])
        place = np.arange(len(h)) - at[row]
        some = many[row] < size
        part = np.zeros(rows, np.uint64)
        np.add.at(part, row[some], h[some] * coef[place[some]])
        value = np.concatenate([value, mix(part[short] + stream(3, size)[many[short]])])
        of = np.concatenate([of, short])
    # sorted by value, then (stably, by radix) by row: all 64 bits of a value tell shingles apart
    order = np.argsort(value)
    order = order[np.argsort(of[order].astype(np.uint16), kind="stable")]
    value, of = value[order], of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[new], of[new]
    return value, np.searchsorted(of, np.arange(rows + 1))
