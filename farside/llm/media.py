"""Telephony audio: mu-law, A-law and ADPCM to linear PCM, at one sample rate.

Mu-law and A-law samples are expanded by tables of 256 entries; IMA ADPCM is decoded with one numpy step for each sample
position over all blocks of a batch at once; the result is resampled by linear interpolation in whole numbers and stored
as 16-bit PCM in a RIFF container.

Defined results of to_pcm(): null media gives null columns; a container that cannot be read gives nulls and its reason in
`error`; no samples give an empty container; a last ADPCM block that is too short for its header is left out, a shorter
one with a header is decoded as far as it goes; media of any length are decoded whole, in memory in proportion to one row;
repeated rows repeat; an empty table gives an empty result; other columns are kept.
Of op9_audio(): null text counts as empty, and so is stored as one padded frame of 576 bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import column_name, small_batches

# WAVE format tags, IMA ADPCM step sizes and step index changes.
TAGS = {"pcm": 1, "alaw": 6, "mulaw": 7, "ima": 17}
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
        118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
        1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
        6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
        32767,
    ],
    np.int32,
)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)

FRAME, RATE, TARGET_RATE = 576, 8000, 16000


def _mulaw() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) * 2 + 33) << ((code >> 4) & 7)) - 33
    return (4 * np.where(code & 0x80, -size, size)).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    low, part = (code & 0x0F) * 16 + 8, (code >> 4) & 7
    size = np.where(part == 0, low, (low + 256) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw(), _alaw()
#: What a nibble adds for each step index: (step >> 3) and, by its bits, step, step >> 1 and step >> 2; the top bit is the sign.
_DELTA = np.stack([(STEPS >> 3) + (n & 4 and STEPS) + (n & 2 and STEPS >> 1) + (n & 1 and STEPS >> 2) for n in range(8)], axis=1).astype(np.int32)
DELTAS = np.concatenate([_DELTA, -_DELTA], axis=1).ravel()
NEXT = np.clip(np.arange(len(STEPS))[:, None] + np.tile(CHANGES, 2)[None, :], 0, len(STEPS) - 1).astype(np.int32).ravel()


def decode_ima(blocks: np.ndarray, channels: int = 1) -> np.ndarray:
    """IMA ADPCM blocks (n, bytes a block) to samples (n, samples a block, channels): one pass over the positions in a
    block, each for all n blocks. Step indices beyond the table count as its last."""
    n, size = blocks.shape
    words = (size - 4 * channels) // (4 * channels)
    head = blocks[:, : 4 * channels].reshape(n, channels, 4)
    level = np.ascontiguousarray(head[:, :, :2]).view("<i2")[:, :, 0].astype(np.int32).reshape(-1)
    index = np.minimum(head[:, :, 2], len(STEPS) - 1).astype(np.int32).reshape(-1)
    body = blocks[:, 4 * channels : 4 * channels * (1 + words)].reshape(n, words, channels, 4).transpose(1, 3, 0, 2).reshape(words * 4, n * channels)
    out = np.empty((1 + words * 8, n * channels), np.int16)
    out[0] = level
    for k, codes in enumerate(body):
        for half, nibble in enumerate((codes & 15, codes >> 4)):
            at = (index << 4) + nibble
            level += DELTAS[at]
            np.clip(level, -32768, 32767, out=level)
            index = NEXT[at]
            out[1 + 2 * k + half] = level
    return out.T.reshape(n, channels, -1).transpose(0, 2, 1)


def resample(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation in whole numbers, from rate to target samples a second."""
    if rate == target or not len(samples):
        return samples
    if target == 2 * rate:
        out = np.empty(2 * len(samples), np.int16)
        out[::2] = samples
        wide = samples.astype(np.int32)
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = samples[-1]
        return out
    place = np.arange(len(samples) * target // rate, dtype=np.int64) * rate
    at, part = place // target, place % target
    left, right = samples[at].astype(np.int64), samples[np.minimum(at + 1, len(samples) - 1)].astype(np.int64)
    return (left + (right - left) * part // target).astype(np.int16)


def wav(data: bytes, codec: str, rate: int = RATE, channels: int = 1, block: int | None = None) -> bytes:
    """A RIFF container around data."""
    block = block or {"pcm": 2, "ima": 256}.get(codec, 1) * channels
    per_block = ((block - 4 * channels) * 2 // channels + 1) if codec == "ima" else 1
    bits = {"pcm": 16, "ima": 4}.get(codec, 8)
    extra = struct.pack("<HH", 2, per_block) if codec == "ima" else b"" if codec == "pcm" else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", TAGS[codec], channels, rate, rate * block // per_block, block, bits) + extra
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt
    if codec != "pcm":
        chunks += b"fact" + struct.pack("<II", 4, len(data) // block * per_block)
    chunks += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wav(stored: bytes) -> tuple[str, int, int, int, bytes]:
    """(codec, rate, channels, bytes a block, data) of a container; ValueError if it cannot be read."""
    if len(stored) < 12 or stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE container")
    at, fmt = 12, None
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], int.from_bytes(stored[at + 4 : at + 8], "little")
        if name == b"fmt " and size >= 16 and at + 8 + size <= len(stored):
            fmt = struct.unpack("<HHIIHH", stored[at + 8 : at + 24])
        if name == b"data":
            if fmt is None:
                break
            codec = next((c for c, tag in TAGS.items() if tag == fmt[0]), None)
            wide = {"pcm": 16, "ima": 4}.get(codec, 8)
            if codec is None or not 1 <= fmt[1] <= 8 or not fmt[2] or fmt[5] != wide or fmt[4] < (8 if codec == "ima" else 1) * fmt[1]:
                raise ValueError("unsupported format")
            return codec, fmt[2], fmt[1], fmt[4], stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def decode(stored: bytes) -> tuple[str, int, np.ndarray]:
    """(codec, rate, samples: channels mixed to one) of a container."""
    codec, rate, channels, block, data = read_wav(stored)
    raw = np.frombuffer(data, np.uint8)
    if codec == "ima":
        whole = len(raw) // block
        parts = [decode_ima(raw[: whole * block].reshape(whole, block), channels).reshape(-1, channels)] if whole else []
        if len(rest := raw[whole * block :]) >= 4 * channels:
            parts.append(decode_ima(rest[None, :], channels).reshape(-1, channels))
        frames = np.concatenate(parts) if parts else np.empty((0, channels), np.int16)
    else:
        flat = MULAW[raw] if codec == "mulaw" else ALAW[raw] if codec == "alaw" else raw[: len(raw) // 2 * 2].view("<i2")
        frames = flat[: len(flat) // channels * channels].reshape(-1, channels)
    return codec, rate, frames[:, 0] if channels == 1 else (frames.sum(axis=1, dtype=np.int32) // channels).astype(np.int16)


def to_pcm(df: DataFrame, media_col: str = "media", rate: int = TARGET_RATE) -> DataFrame:
    """df with codec, source_rate, n_samples, pcm (a container of 16-bit samples at `rate`) and error behind it."""
    small_batches(df.sparkSession)
    names = []
    for base in ("codec", "source_rate", "n_samples", "pcm", "error"):
        names.append(column_name(df, base))
    kinds = (T.StringType(), T.IntegerType(), T.LongType(), T.BinaryType(), T.StringType())
    out, at = T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))]), df.columns.index(media_col)

    def one(stored):
        if stored is None:
            return None, None, None, None, None
        try:
            codec, source, samples = decode(stored)
        except ValueError as e:
            return None, None, None, None, str(e)
        samples = resample(samples, source, rate)
        return codec, source, len(samples), wav(samples.astype("<i2").tobytes(), "pcm", rate), None

    def run(batches):
        for big in batches:
            for k in range(0, big.num_rows, 16):  # of long sounds
                batch = big.slice(k, 16)
                cols = zip(*(one(x) for x in batch.column(at).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string())))], names=out.names)

    return df.mapInArrow(run, out)


def _features(payloads: list[bytes], sounds: list[bytes]) -> list[str]:
    """Of every payload: level and zero crossings as mu-law, level as A-law, level as ADPCM blocks of one frame each (all
    payloads' blocks are decoded together), and the checksum of the samples in its stored, resampled PCM."""
    counts = [len(p) // FRAME for p in payloads]
    starts = np.r_[0, np.cumsum(counts)[:-1]]
    joined = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME)
    power = np.empty(len(joined), np.int64)
    for k in range(0, len(joined), 2048):
        decoded = decode_ima(joined[k : k + 2048])[:, :, 0].astype(np.float64)
        power[k : k + 2048] = np.einsum("ij,ij->i", decoded, decoded).astype(np.int64)  # whole numbers below 2**53: exact
    power = np.add.reduceat(power, starts)
    squares = [t.astype(np.int64) ** 2 for t in (MULAW, ALAW)]
    per_block = (FRAME - 4) * 2 + 1
    out = []
    for p, n, w, stored in zip(payloads, counts, power, sounds):
        raw = np.frombuffer(p, np.uint8)
        seen = np.bincount(raw, minlength=256)
        mu, a = (int(np.sqrt(int(seen @ s) / len(raw))) for s in squares)
        sign = raw & 128
        crossings = int(np.count_nonzero(sign[1:] != sign[:-1]))
        pcm = decode(stored)[2]
        out.append(f"mulaw={mu} crossings={crossings} alaw={a} ima={int(np.sqrt(int(w) / (n * per_block)))} pcm{TARGET_RATE}={zlib.crc32(pcm.astype('<i2', copy=False).tobytes()):08x}")
    return out


def as_mulaw(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text's bytes, padded to whole frames, as the samples of a mu-law container."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        for big in batches:
            for k in range(0, big.num_rows, 256):
                batch = big.slice(k, 256)
                raw = [(text or "").encode() for text in batch.column(1).to_pylist()]
                media = [wav(r + b"\xff" * ((-len(r)) % FRAME if r else FRAME), "mulaw") for r in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def described(sounds: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, pcm) as as_mulaw() and to_pcm() store them to digests and features of what is read back."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for big in batches:
            for k in range(0, big.num_rows, 256):
                batch = big.slice(k, 256)
                media, pcm = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                payloads = [read_wav(m)[4] for m in media]
                cols = [
                    batch.column(0), batch.column(1), pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array(_features(payloads, pcm)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return sounds.mapInArrow(run, schema)


def op9_audio(spark, sf_dir: str) -> DataFrame:
    """Every document's bytes stored as mu-law samples, decoded, resampled and stored as PCM, read back and described."""
    sounds = to_pcm(as_mulaw(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return described(sounds.select("doc_id", "n_bytes", "media", "pcm"))
