"""Audio against scalar readings: ADPCM by the standard's steps, resampling by its sum, tones above the new band gone."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.llm import media


def _decoded(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media._STEPS[index])
            change = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                change += part if code & bit else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(value)
    return out


def test_adpcm_equals_a_scalar_decoder():
    blocks = np.random.default_rng(1).integers(0, 256, (40, media.BLOCK)).astype(np.uint8)
    assert media.adpcm_pcm(blocks).tolist() == [_decoded(bytes(b)) for b in blocks]


@pytest.mark.parametrize("rate, to", [(8000, 4000), (8000, 16000), (8000, 11025), (16000, 8000)])
def test_resampling_equals_its_sum(rate, to):
    x = np.random.default_rng(2).integers(-20000, 20000, 300).astype(np.int16)
    band = min(1.0, to / rate)
    want = []
    for k in range(-(-300 * to // rate)):
        t = (np.arange(-400, 700) - k * rate / to) * band
        w = np.where(np.abs(t) < media.CROSSINGS, np.sinc(t) * np.cos(np.pi * t / 2 / media.CROSSINGS) ** 2, 0)
        want.append((w[400:700] * x).sum() / w.sum())
    got = media.resample(x, rate, to)
    assert len(got) == len(want) and np.abs(got - np.array(want)).max() <= 1


def test_nothing_aliases():
    t = np.arange(8000) / 8000
    high = media.resample((10000 * np.sin(2 * np.pi * 3000 * t)).astype(np.int16), 8000, 4000)
    low = media.resample((10000 * np.sin(2 * np.pi * 500 * t)).astype(np.int16), 8000, 4000)
    assert np.abs(high[50:-50]).max() < 30
    assert np.abs(low[50:-50] - 10000 * np.sin(2 * np.pi * 500 * t[::2][50:-50])).max() < 30


def test_stored_pcm_and_digests(spark):
    texts = ["é one", "", None, "long text " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("pcm", F.lit(1))
    for r in media.telephony(docs).collect():
        payload = (texts[r.doc_id] or "").encode()
        payload += b"\xff" * (-len(payload) % 576 or (0 if payload else 576))
        data = r.pcm
        assert data[:4] == b"RIFF" and np.frombuffer(data[44:], "<i2").tolist() == media.resample(media.MULAW_PCM[np.frombuffer(payload, np.uint8)], 8000, 4000).tolist()
        head = b"RIFF" + (50 + len(payload)).to_bytes(4, "little") + b"WAVEfmt \x12\0\0\0\x07\0\x01\0@\x1f\0\0@\x1f\0\0\x01\0\x08\0\0\0fact\x04\0\0\0" + len(payload).to_bytes(4, "little") + b"data" + len(payload).to_bytes(4, "little")
        assert r.media_sha256 == hashlib.sha256(head + payload).hexdigest() and r.media_bytes == len(head + payload)
