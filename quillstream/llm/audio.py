"""Media columns, telephony audio: a text's bytes as 8-bit companded samples in a WAVE container, and their decoding by numpy.

``store`` writes a Parquet table with a binary ``media`` column: a mu-law WAVE file (format 7, 8 kHz, mono) whose samples are
the UTF-8 bytes, padded with 0 to a positive multiple of 64. Nothing is expanded on the way, so the payload is kept as it is.
``load`` reads such a table back, takes the samples out of the container, and decodes them three ways: mu-law and A-law by
lookup tables, and as IMA ADPCM blocks of 64 bytes (4 of header, 120 samples of 4 bits), where numpy works across all blocks
of a slice, one sample position after the other. With ``pcm`` (a rate in Hz) it also returns the mu-law signal resampled to that
rate, as 16-bit little-endian PCM, for the table that the caller stores; ``feature`` always holds the crc32 of the signal at
PCM_RATE. Rates are multiples or fractions of the telephone's: 16 kHz is four times the payload's bytes, 4 kHz as many.

Defined cases: null text counts as empty, whose payload is 64 zero bytes; equal texts give equal values; repeated and null
ids stay; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import shared_path, slices, table, utf8

BLOCK, RATE, PCM_RATE = 64, 8000, 4000
#: Fixed values of IMA ADPCM: the quantiser's steps, and how a sample's magnitude moves the step index.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494,
    544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635,
    13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mu_law_table() -> np.ndarray:
    """PCM of each mu-law code (G.711)."""
    code = ~np.arange(256) & 0xFF
    magnitude = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -magnitude, magnitude).astype(np.int16)


def a_law_table() -> np.ndarray:
    """PCM of each A-law code (G.711)."""
    code = np.arange(256) ^ 0x55
    part, step = code >> 4 & 7, (code & 15) << 4
    magnitude = np.where(part == 0, step + 8, step + 264 << np.maximum(part - 1, 0))
    return np.where(code & 128, magnitude, -magnitude).astype(np.int16)


MU_LAW, A_LAW = mu_law_table(), a_law_table()


def _moved() -> tuple[np.ndarray, np.ndarray]:
    """Of each step index and 4-bit sample: the difference to add, and the next index."""
    code, step = np.arange(16)[None, :], STEPS[:, None]
    size = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
    after = np.clip(np.arange(len(STEPS))[:, None] + MOVES[code & 7], 0, len(STEPS) - 1)
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), (after.astype(np.int32) * 16).ravel()


_DELTA, _NEXT = _moved()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """blocks: n x size bytes, each a 4-byte header (first sample, step index, unused) and two samples a byte, low half first.

    Returns n x (2 * (size - 4) + 1) samples. Step indices beyond the table count as its last.
    """
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1) * 16
    codes = np.ascontiguousarray(blocks[:, 4:].T)  # a row per byte position: numpy runs along all blocks
    out = np.empty((2 * len(codes) + 1, len(blocks)), np.int16)
    out[0] = value
    for k, both in enumerate(codes):
        for half, code in ((1, both & 15), (2, both >> 4)):
            at = index + code
            value = np.clip(value + _DELTA[at], -32768, 32767)
            index = _NEXT[at]
            out[2 * k + half] = value
    return out.T


def resample(pcm: np.ndarray, ends: np.ndarray, rate: int = PCM_RATE) -> np.ndarray:
    """Joined signals (that end at `ends`) at another rate, in integers. A multiple: linear interpolation, the last sample of each is held. A fraction: means of so many samples, of which every signal is a multiple."""
    here = pcm.astype(np.int32)
    if rate < RATE:
        if RATE % rate or (np.diff(ends, prepend=0) % (RATE // rate)).any():
            raise ValueError(f"{rate} Hz is no fraction of {RATE} Hz that divides the signals")
        return (here.reshape(-1, RATE // rate).sum(axis=1) // (RATE // rate)).astype("<i2")
    if rate % RATE:
        raise ValueError(f"{rate} Hz is no multiple of {RATE} Hz")
    factor = rate // RATE
    after = np.append(here[1:], 0)
    after[ends - 1] = here[ends - 1]
    return np.stack([(here * (factor - k) + after * k) // factor for k in range(factor)], axis=1).astype("<i2").ravel()


def container(payload: bytes) -> bytes:
    """A WAVE file of mu-law samples."""
    fmt = struct.pack("<HHIIHHH", 7, 1, RATE, RATE, 1, 8, 0)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, len(payload)) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def samples(media: bytes) -> bytes:
    """The data chunk of a WAVE file of 8-bit mu-law samples."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at = 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and (kind := struct.unpack_from("<HHIIHH", media, at + 8))[0::5] != (7, 8):
            raise ValueError(f"not 8-bit mu-law: {kind}")
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def store(docs: DataFrame, path: str) -> None:
    """Writes doc_id, n_bytes and media as Parquet."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            media = [container(t + b"\0" * (-len(t) % BLOCK if t else BLOCK)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    rows.mapInArrow(put, "doc_id long, n_bytes long, media binary").write.option("compression", "zstd").parquet(path)


def _measure(pcm: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean square, peak and number of sign changes of joined signals."""
    starts, n = bounds[:-1], np.diff(bounds)
    wide = pcm.astype(np.int64)
    change = np.concatenate([[0], (pcm[1:] < 0) != (pcm[:-1] < 0)]).astype(np.int64)
    change[starts] = 0
    return np.add.reduceat(wide * wide, starts) // n, np.maximum.reduceat(np.abs(wide), starts), np.add.reduceat(change, starts)


def load(spark: SparkSession, path: str, pcm: int | None = None) -> DataFrame:
    """Reads a folder of ``store`` and decodes each row's samples; with a rate also returns them as PCM."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", pcm binary" * bool(pcm)

    def resampled(mu: np.ndarray, bounds: np.ndarray, rate: int) -> list[np.ndarray]:
        wave = resample(mu, bounds[1:], rate).view(np.uint8)
        return [wave[a:b] for a, b in zip((bounds[:-1] * 2 * rate // RATE).tolist(), (bounds[1:] * 2 * rate // RATE).tolist(), strict=True)]

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, media in slices(batches, "media", 1_000_000):
            payloads = [samples(m) for m in media]
            size = np.fromiter(map(len, payloads), np.int64, len(payloads))
            bounds = np.concatenate([[0], np.cumsum(size)])
            code = np.frombuffer(b"".join(payloads), np.uint8)
            mu = MU_LAW[code]
            adpcm = decode_adpcm(code.reshape(-1, BLOCK)).ravel()
            found = [_measure(x, b) for x, b in ((mu, bounds), (A_LAW[code], bounds), (adpcm, bounds // BLOCK * (2 * (BLOCK - 4) + 1)))]
            waves = resampled(mu, bounds, PCM_RATE)
            measured = zip(*(x.tolist() for kind in found for x in kind), size.tolist(), map(zlib.crc32, waves), strict=True)
            feature = ["mulaw=%d/%d/%d;alaw=%d/%d/%d;adpcm=%d/%d/%d;pcm4k=%d/%08x" % (*m[:9], m[9] * PCM_RATE // RATE, m[10]) for m in measured]
            columns = [
                batch.column(0), batch.column(1), pa.array(size), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array([zlib.crc32(p[-BLOCK:]) for p in payloads], pa.int64()),
                pa.array(list(map(len, media)), pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array(feature),
            ]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            if pcm:
                columns.append(pa.array([w.tobytes() for w in (waves if pcm == PCM_RATE else resampled(mu, bounds, pcm))], pa.binary()))
                names.append("pcm")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return spark.read.schema("doc_id long, n_bytes long, media binary").parquet(path).mapInArrow(get, schema)


def op5_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "audio")
    store(table(spark, sf_dir, "documents"), path)
    return load(spark, path, pcm=PCM_RATE)
