"""Texts as WAV media columns with spectral-peak fingerprints (operator 4)."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import sliced, written

#: Payloads are filled with spaces up to a positive multiple of this.
UNIT = 192
RATE = 16_000
#: Samples in a short-time Fourier frame, and from one frame to the next.
FRAME, HOP = 192, 96
#: First bin of each band, and the end of the last; one spectral peak per band and frame at most.
BANDS = (2, 10, 20, 40, 97)
#: A peak is paired with so many of the next ones, within so many frames.
FAN_OUT, REACH = 3, 64
#: Frames transformed at once.
_CHUNK = 4096


def wav_bytes(payload: bytes) -> bytes:
    """Mono 8-bit PCM WAV whose samples are the payload."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def wav_payload(media: bytes) -> bytes:
    """The samples of a WAV, as the wave module reads them."""
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def spectral_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of band maxima that beat their neighbours in time and the band's mean.

    Samples are unsigned bytes with silence at 128.  Frames are Hann-weighted.  Sound too short
    for a frame has no peaks.
    """
    x = samples.astype(np.float32) - 128
    n = (len(x) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    hann = np.hanning(FRAME).astype(np.float32)
    k = len(BANDS) - 1
    best, where, mean = np.empty((n, k), np.float32), np.empty((n, k), np.int64), np.empty((n, k), np.float32)
    for lo in range(0, n, _CHUNK):
        f = np.fft.rfft(frames[lo : lo + _CHUNK] * hann, axis=1)
        power = f.real**2 + f.imag**2
        for b in range(k):
            band = power[:, BANDS[b] : BANDS[b + 1]]
            at = band.argmax(axis=1)
            where[lo : lo + _CHUNK, b] = at + BANDS[b]
            best[lo : lo + _CHUNK, b] = np.take_along_axis(band, at[:, None], 1)[:, 0]
            mean[lo : lo + _CHUNK, b] = band.mean(axis=1)
    edge = np.full((1, k), -1, np.float32)
    before, after = np.vstack([edge, best[:-1]]), np.vstack([best[1:], edge])
    peak = (best > before) & (best >= after) & (best > 3 * mean)
    t, b = np.nonzero(peak)
    return t, where[t, b]


def landmarks(frame: np.ndarray, bin_: np.ndarray) -> np.ndarray:
    """Time-coded peak pairs, ascending: frame << 24 | bin << 16 | other bin << 8 | frames between."""
    out = []
    for step in range(1, FAN_OUT + 1):
        dt = frame[step:] - frame[:-step]
        ok = dt <= REACH
        out.append((frame[:-step][ok] << 24) | (bin_[:-step][ok] << 16) | (bin_[step:][ok] << 8) | dt[ok])
    return np.sort(np.concatenate(out)) if len(frame) > 1 else np.zeros(0, np.int64)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, media = [], []
        for text in batch.column(1).to_pylist():
            raw = (text or "").encode()
            sizes.append(len(raw))
            media.append(wav_bytes(raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text (null: empty) as a WAV whose samples are its UTF-8 bytes and the filling spaces.

    One row for each row of ``docs``, so null doc_ids stay null and repeats repeat; other columns are not looked at.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sliced(_encode), "doc_id long, n_bytes long, media binary")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media in batch.column("media").to_pylist():
            payload = wav_payload(media)
            t, f = spectral_peaks(np.frombuffer(payload, np.uint8))
            codes = landmarks(t, f)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), len(t), codes.tolist(), xxhash.xxh64_hexdigest(codes.astype("<i8").tobytes())))
        cols = list(zip(*rows)) or [()] * 8
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.string()]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_peaks", "landmarks", "landmarks_xxh64"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_bytes", *names])


def media_features(media: DataFrame) -> DataFrame:
    """Digests of the stored and the read-back bytes, and the landmarks of each WAV of ``to_media``."""
    return media.mapInArrow(sliced(_features), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_peaks long, landmarks array<long>, landmarks_xxh64 string")


def media_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns and the landmarks; ``feature`` names the peaks, the landmarks and the digest of their codes."""
    got = media_features(written(to_media(docs), "media"))
    feature = F.concat_ws(":", "n_peaks", F.size("landmarks"), "landmarks_xxh64")
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "landmarks")
