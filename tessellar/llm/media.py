"""Media columns of telephony audio.

A payload of bytes is stored as the 8-bit samples of a WAVE file (mu-law or
A-law) or as its ADPCM blocks, which is lossless for the bytes whatever they
are. Reading parses the file again. G.711 codes expand through tables of 256
entries, ADPCM blocks decode with numpy, all blocks of a batch at a time, and
PCM can be resampled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship

RATE = 8000
UNIT = 576  #: bytes of a payload are a multiple of this
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 0x11
#: ADPCM: bytes of a block, a header of 4 (first sample, step index) and two samples a byte
BLOCK = 288
#: Blocks that are decoded at once.
AT_ONCE = 8192

#: Fixed values of the ADPCM standard: how the step index moves.
_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: Fixed values of the ADPCM standard: the 89 step sizes.
_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def _mulaw(code: int) -> int:
    code = ~code & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return -size if code & 0x80 else size


def _alaw(code: int) -> int:
    code ^= 0x55
    part, low = code >> 4 & 7, (code & 0x0F) << 4
    size = low + 8 if part == 0 else low + 0x108 << part - 1
    return size if code & 0x80 else -size


MULAW_PCM = np.array([_mulaw(k) for k in range(256)], np.int16)
ALAW_PCM = np.array([_alaw(k) for k in range(256)], np.int16)


def expand(codes: bytes, form: int = MULAW) -> np.ndarray:
    """16-bit PCM of G.711 codes."""
    return (MULAW_PCM if form == MULAW else ALAW_PCM)[np.frombuffer(codes, np.uint8)]


def adpcm_pcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of ADPCM blocks (a row of bytes each): one time step at once over all blocks."""
    out = np.empty((len(blocks), 1 + 2 * (blocks.shape[1] - 4)), np.int16)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[:, 0] = value
    at = 1
    for k in range(4, blocks.shape[1]):
        for nibble in (blocks[:, k] & 15, blocks[:, k] >> 4):
            step = _STEPS[index]
            change = step >> 3
            change += (nibble & 1) * (step >> 2) + (nibble >> 1 & 1) * (step >> 1) + (nibble >> 2 & 1) * step
            value = np.clip(np.where(nibble & 8, value - change, value + change), -32768, 32767)
            index = np.clip(index + _MOVES[nibble], 0, 88)
            out[:, at] = value
            at += 1
    return out


#: Zero crossings of the low-pass on either side, and output samples that are made at once.
CROSSINGS, CHUNK = 16, 1 << 15


@lru_cache(64)
def _low_pass(up: int, down: int) -> np.ndarray:
    """A row of weights for each place of an output between two samples."""
    band = min(1.0, up / down)
    reach = int(np.ceil(CROSSINGS / band))
    t = (np.arange(-reach, reach + 2) - np.arange(up)[:, None] / up) * band
    w = np.sinc(t) * np.where(np.abs(t) < CROSSINGS, np.cos(np.pi * t / (2 * CROSSINGS)) ** 2, 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """``ceil(len * to / rate)`` samples, by a windowed sinc whose band ends at the lower of both Nyquist rates.

    In lowest terms to / rate is up / down: output k lies at k * down / up, so
    there are ``up`` sets of weights, each summing to 1, and each output is one
    product over the samples around it. Beyond the ends is silence.
    """
    step = gcd(rate, to)
    up, down = to // step, rate // step
    n = -(-len(pcm) * up // down)
    if not n or not len(pcm):
        return np.zeros(0, np.int16)
    if up == down:
        return pcm.astype(np.int16)
    weights = _low_pass(up, down)
    reach = weights.shape[1] // 2 - 1
    padded = np.concatenate([np.zeros(reach), pcm, np.zeros(reach + 2)])
    views = np.lib.stride_tricks.sliding_window_view(padded, weights.shape[1])
    out = np.empty(n, np.int16)
    for k in range(up):
        for first in range(k, n, CHUNK * up):
            own = np.arange(first, min(n, first + CHUNK * up), up)
            out[own] = np.rint(views[own * down // up] @ weights[k * down % up]).clip(-32768, 32767)
    return out


def store(payload: bytes, form: int = MULAW, rate: int = RATE) -> bytes:
    """A WAVE file whose samples are the payload's bytes."""
    if form == ADPCM:
        per = 1 + 2 * (BLOCK - 4)
        head = struct.pack("<HHIIHHHH", form, 1, rate, rate * BLOCK // per, BLOCK, 4, 2, per)
    else:
        head = struct.pack("<HHIIHHH", form, 1, rate, rate, 1, 8, 0)
    count = struct.pack("<4sII", b"fact", 4, len(payload) // BLOCK * (1 + 2 * (BLOCK - 4)) if form == ADPCM else len(payload))
    body = b"fmt " + struct.pack("<I", len(head)) + head + count + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def read(media: bytes) -> tuple[int, int, bytes]:
    """Form, rate and payload of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            form, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            return form, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def samples(media: bytes) -> tuple[int, np.ndarray]:
    """Rate and PCM of a stored file of any of the forms."""
    form, rate, payload = read(media)
    if form == PCM:
        return rate, np.frombuffer(payload, "<i2")
    if form == ADPCM:
        blocks = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
        return rate, np.concatenate([adpcm_pcm(blocks[k : k + AT_ONCE]).ravel() for k in range(0, len(blocks), AT_ONCE)] or [np.zeros(0, np.int16)])
    return rate, expand(payload, form)


def store_pcm(pcm: np.ndarray, rate: int) -> bytes:
    """A WAVE file of 16-bit PCM."""
    data = pcm.astype("<i2").tobytes()
    head = struct.pack("<HHIIHH", PCM, 1, rate, 2 * rate, 2, 16)
    return b"RIFF" + struct.pack("<I", 28 + 8 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(data)) + data


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and those with 255 appended up to a positive multiple of UNIT."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\xff" * (UNIT - len(data) % UNIT if len(data) % UNIT or not data else 0)


def describe(pcm: np.ndarray) -> str:
    """Loudness, peak and crossings of zero, in whole numbers."""
    x = pcm.astype(np.int64)
    return f"{int(np.sqrt(float(x @ x) / len(x)))}/{int(np.abs(x).max())}/{int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))}"


NAMES = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]


def _described(ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    rows: list[tuple] = []
    backs: list[bytes] = []
    for text in texts:
        n, payload = payload_of(text)
        media = store(payload)
        _, _, back = read(media)
        backs.append(back)
        rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest()))
    # the same bytes as ADPCM blocks: all documents' blocks at once
    every = np.frombuffer(b"".join(backs), np.uint8).reshape(-1, BLOCK)
    blocks = np.concatenate([adpcm_pcm(every[k : k + AT_ONCE]) for k in range(0, len(every), AT_ONCE)] or [np.zeros((0, 569), np.int16)])
    at = 0
    for k, back in enumerate(backs):
        n = len(back) // BLOCK
        kept = store_pcm(resample(expand(back, MULAW), RATE, RATE // 2), RATE // 2)
        half = samples(kept)[1]
        feature = f"mulaw={describe(expand(back, MULAW))};half={describe(half)};alaw={describe(expand(back, ALAW))};adpcm={describe(blocks[at : at + n].ravel())}"
        rows[k] = (*rows[k], feature, kept)
        at += n
    cols = list(zip(*rows, strict=True)) or [()] * len(KINDS)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, KINDS, strict=True))], NAMES)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, size, texts = 0, 0, []
        for k, text in enumerate(batch.column(1)):
            texts.append(text.as_py())
            size += len(texts[-1] or "") + UNIT
            if size >= BLOCK * AT_ONCE:
                yield _described(batch.column(0).slice(first, len(texts)), texts)
                first, size, texts = k + 1, 0, []
        yield _described(batch.column(0).slice(first, len(texts)), texts)


def telephony(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with the figures of its stored audio, in one pass without a shuffle.

    Columns: ``id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, pcm``. The features come from the
    bytes as read back: as mu-law (also at half the rate, from the WAVE file of
    16-bit samples that ``pcm`` stores), as A-law and as ADPCM blocks, each
    with root mean square, peak and zero crossings. A null text counts as
    empty, which is one unit of padding; null ids and repeated rows are kept.
    An empty table gives an empty result; other columns are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_run, "id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, pcm binary").withColumnRenamed("id", id_col)


def media_column(docs: DataFrame, text_col: str = "text", form: int = MULAW, rate: int = 2 * RATE) -> DataFrame:
    """``docs`` with ``media`` (the stored payload) and ``pcm`` (a file of its PCM, resampled to ``rate``)."""
    ship(docs.sparkSession)

    @F.pandas_udf("media binary, pcm binary")
    def made(text):
        import pandas as pd

        media = [store(payload_of(x)[1], form) for x in text]
        pcm = [store_pcm(resample(p, r, rate), rate) for r, p in map(samples, media)]
        return pd.DataFrame({"media": media, "pcm": pcm})

    return docs.withColumn("__made", made(F.col(text_col))).withColumns({"media": F.col("__made.media"), "pcm": F.col("__made.pcm")}).drop("__made")
