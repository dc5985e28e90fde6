import hashlib
import zlib

import numpy as np
from common import ODD, clash, directory, docs, frame, plain

from farside.llm import media


def slow_ima(block: bytes) -> list[int]:
    """One sample after the other, by the textbook."""
    level = int.from_bytes(block[:2], "little", signed=True)
    index = min(block[2], 88)
    out = [level]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            delta = step >> 3
            delta += step if code & 4 else 0
            delta += step >> 1 if code & 2 else 0
            delta += step >> 2 if code & 1 else 0
            level = max(-32768, min(32767, level + (-delta if code & 8 else delta)))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(level)
    return out


def test_ima_over_blocks():
    blocks = np.random.default_rng(1).integers(0, 256, (50, 256), np.uint8)
    got = media.decode_ima(blocks)[:, :, 0]
    assert got.tolist() == [slow_ima(b.tobytes()) for b in blocks]


def test_ima_stereo_is_interleaved_by_words():
    rng = np.random.default_rng(2)
    left, right = (rng.integers(0, 256, 4 + 8, np.uint8) for _ in range(2))
    both = np.concatenate([left[:4], right[:4], left[4:8], right[4:8], left[8:], right[8:]])
    got = media.decode_ima(both[None, :], 2)[0]
    assert got[:, 0].tolist() == slow_ima(left.tobytes()) and got[:, 1].tolist() == slow_ima(right.tobytes())


def test_tables():
    mu, a = media.MULAW.astype(int), media.ALAW.astype(int)
    assert mu[0] == -32124 and mu[0x80] == 32124 and mu[0x7F] == 0 and mu[0xFF] == 0 and mu[0x8F] == 16764
    assert a[0xD5] == 8 and a[0x55] == -8 and a[0xAA] == 32256 and a[0x2A] == -32256
    assert (mu[:128] == -mu[128:]).all() and (a[:128] == -a[128:]).all() and len(set(a)) == 256


def test_container_round_trip():
    raw = bytes(range(256)) * 3
    for codec in ("mulaw", "alaw"):
        assert media.read_wav(media.wav(raw, codec)) == (codec, 8000, 1, 1, raw)
    assert media.read_wav(media.wav(raw, "ima", block=256))[::4] == ("ima", raw)
    odd = media.wav(b"abc", "mulaw")
    assert len(odd) % 2 == 0 and media.read_wav(odd)[4] == b"abc"


def test_resample():
    x = np.array([0, 100, -100, 7], np.int16)
    assert media.resample(x, 8000, 16000).tolist() == [0, 50, 100, 0, -100, -47, 7, 7]
    assert media.resample(x, 16000, 8000).tolist() == [0, -100]
    assert len(media.resample(np.arange(441, dtype=np.int16), 44100, 16000)) == 160
    assert media.resample(x[:0], 8000, 16000).tolist() == []


def test_to_pcm_of_odd_rows(spark):
    good = media.wav(bytes(100), "alaw")
    short = media.wav(np.random.default_rng(3).integers(0, 256, 300, np.uint8).tobytes(), "ima", block=256)
    rows = [(1, None), (2, b""), (3, b"RIFF....WAVE"), (4, good), (4, good), (5, media.wav(b"", "mulaw")), (6, short), (None, good[:30])]
    df = clash(spark.createDataFrame(rows, "id long, media binary"), "codec", "pcm")
    out = media.to_pcm(df).collect()
    assert len(out) == len(rows)
    got = {r.id: r for r in out}
    assert got[1].error is None and got[1]._pcm is None and got[2].error and got[3].error == "no samples" and got[None].error
    assert got[4]._codec == "alaw" and got[4].n_samples == 200 and media.read_wav(bytes(got[4]._pcm))[1] == 16000
    assert got[5].n_samples == 0 and got[6].n_samples == 2 * (505 + 1 + 80)
    assert media.to_pcm(spark.createDataFrame([], "id long, media binary")).count() == 0


def test_query(spark, tmp_path):
    rows = [*ODD, ODD[4], (9, "x" * 576, "en", "s", 1), (10, "x" * 577, "en", "s", 1), (11, "word", "de", "t", 4), (12, "é" * 200_000, "en", "s", 1)]
    out = frame(media.op9_audio(spark, directory(tmp_path, documents=docs(spark, rows))))
    assert len(out) == len(rows)
    for i, text, *_ in rows:
        raw = (text or "").encode()
        size = max(576, -(-len(raw) // 576) * 576)
        padded = raw.ljust(size, b"\xff")
        got = (out[out.doc_id == i] if i is not None else out[out.doc_id.isna()]).iloc[0]
        assert (got.n_bytes, got.payload_bytes, got.tail_crc32) == (len(raw), size, zlib.crc32(padded[-32:]))
        assert got.payload_sha256 == hashlib.sha256(padded).hexdigest() and got.media_bytes > size
    assert out[out.doc_id.isin([4, 11])].feature.nunique() == 1
    assert media.op9_audio(spark, directory(tmp_path / "none", documents=plain(spark, []))).count() == 0
