"""Media columns: texts kept as WAV sound, read by the wave module, with spectral-peak fingerprints.

A payload becomes the samples of a mono 8-bit WAV file, byte for byte. A short-time Fourier transform of the
samples read back gives, in each frame and band of frequencies, the strongest bin; those that also stand out
against the frames before and after are peaks. Each peak is paired with the next few in time: the codes of
the pairs (both bins and the distance in frames) and the frames at which they begin are the fingerprint.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawfinder.llm.common import add_columns, table, utf8

#: A payload is filled with bytes 255 to a positive multiple of this many.
UNIT, FILL = 576, 255
RATE = 8000
#: Samples of a frame and from one frame to the next, bands of bins, partners of a peak and frames to the last of them.
FRAME, HOP, BANDS, FAN, REACH = 512, 256, 4, 3, 16
#: Frames that are transformed at once.
BLOCK = 2048


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, bytes([FILL]))


def encode(payload: bytes, rate: int = RATE) -> bytes:
    """A WAV file whose 8-bit samples are the payload."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def decode(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("only mono sound of 8 bits is read")
        return w.readframes(w.getnframes())


_WINDOW = np.hanning(FRAME).astype(np.float32)


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the spectral peaks, in order of time; blocks of frames overlap by one on both sides."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    n = max(1, 1 + -(-(len(x) - FRAME) // HOP))
    x = np.pad(x, (0, (n - 1) * HOP + FRAME - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    when, where = [], []
    width = FRAME // 2 // BANDS
    for at in range(0, n, BLOCK):
        first, last = max(0, at - 1), min(n, at + BLOCK + 1)
        spectrum = np.fft.rfft(frames[first:last] * _WINDOW, axis=1)[:, 1:]
        power = (spectrum.real**2 + spectrum.imag**2).reshape(last - first, BANDS, width)
        best = power.argmax(axis=2)
        top = np.take_along_axis(power, best[:, :, None], axis=2)[:, :, 0]
        level = np.vstack([np.full(BANDS, -1.0), top, np.full(BANDS, -1.0)])
        stands = (top > level[:-2]) & (top >= level[2:]) & (top > 1e-6)
        t, band = np.nonzero(stands[at - first : at - first + min(BLOCK, n - at)])
        when.append(t + at)
        where.append(best[t + at - first, band] + band * width + 1)
    return np.concatenate(when), np.concatenate(where)


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(codes, frames) of the peak pairs: first bin, second bin and distance in frames, in one number."""
    t, f = peaks(samples)
    codes, times = [], []
    for k in range(1, FAN + 1):
        gap = t[k:] - t[:-k]
        near = gap <= REACH
        codes.append(((f[:-k] << 20) | (f[k:] << 8) | gap)[near])
        times.append(t[:-k][near])
    codes, times = np.concatenate(codes).astype(np.int64), np.concatenate(times).astype(np.int64)
    order = np.lexsort((codes, times))
    return codes[order], times[order]


def to_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Add the WAV file of each text (null and empty: one unit of filling) as a binary column."""

    def fresh():
        return lambda column: [pa.array([encode(padded(raw)) for raw in utf8(column)], pa.binary())]

    return add_columns(docs, [text], T.StructType([T.StructField(media, T.BinaryType())]), fresh)


def described(docs: DataFrame, media: str = "media") -> DataFrame:
    """Read each WAV file of a binary column and add its payload's and its own digests and its fingerprint.

    A null file gives null values; a file that is no mono 8-bit WAV fails the query.
    """
    added = T.StructType(
        [
            T.StructField("payload_bytes", T.LongType()),
            T.StructField("payload_sha256", T.StringType()),
            T.StructField("tail_crc32", T.LongType()),
            T.StructField("media_bytes", T.LongType()),
            T.StructField("media_sha256", T.StringType()),
            T.StructField("pair_codes", T.ArrayType(T.LongType())),
            T.StructField("pair_frames", T.ArrayType(T.LongType())),
        ]
    )

    def one(file: bytes) -> tuple:
        payload = decode(file)
        codes, times = fingerprint(payload)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        return len(payload), digest(payload), zlib.crc32(payload[-32:]), len(file), digest(file), codes, times

    def fresh():
        def make(column):
            rows = [one(b) if b is not None else (None,) * 7 for b in column.to_pylist()]
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 7

        return make

    return add_columns(docs, [media], added, fresh)


def op7_media(spark, sf_dir: str) -> DataFrame:
    """The contract's columns (feature: the number of pairs, and the digest of their codes and frames) and the pairs themselves."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    found = described(to_media(docs).drop("text"))
    text = F.concat_ws(";", *[F.array_join(F.col(c).cast("array<string>"), ",") for c in ("pair_codes", "pair_frames")])
    feature = F.concat(F.size("pair_codes").cast("string"), F.lit(":"), F.sha2(text, 256))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "pair_codes", "pair_frames")
