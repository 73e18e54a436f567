"""Media columns: texts as WAV samples, spectral-peak fingerprints read back from them.

``store_media`` puts each text's UTF-8 bytes, padded with 255 to a positive multiple of
``PAD``, into an 8-bit mono WAV file, written by the ``wave`` module as one binary
column of a Parquet table. ``store_fingerprints`` reads those stored bytes with the same
module, cuts them into overlapping frames, takes a short-time Fourier transform and keeps the
strongest bin of each band as a peak; pairs of peaks up to ``REACH`` frames apart become
codes (bins of both, distance) in an array in time order, each with its frame, stored
beside the digests of the bytes read. ``media_digests`` derives its columns from that table.

Defined results: a null or empty text is padding alone; a frame without any
spectrum has no peaks; equal texts have equal values in any batch, as magnitudes are
rounded before peaks are chosen and ties go to the lowest bin. Map-only; a long text is
transformed in blocks, and the Arrow batches are bounded by bytes.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import base

#: Payloads are padded to multiples of PAD samples; frames of WINDOW samples begin every HOP.
PAD, WINDOW, HOP, RATE, REACH, BLOCK = 576, 384, 192, 8000, 2, 2048
#: Bins of the bands; bin 0 is the mean of a frame, not a tone.
BANDS = ((1, 32), (32, 96), (96, 193))
PAIRS = "array<struct<frame: int, code: int>>"


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (max(1, -(-len(data) // PAD)) * PAD - len(data))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(payload: bytes) -> np.ndarray:
    """Of each frame and band the bin of the largest magnitude, or 0 where there is none."""
    frames = np.lib.stride_tricks.sliding_window_view(np.frombuffer(payload, np.uint8), WINDOW)[::HOP]
    window = np.hanning(WINDOW)
    out = np.zeros((len(frames), len(BANDS)), np.int32)
    for at in range(0, len(frames), BLOCK):
        part = frames[at : at + BLOCK].astype(np.float64)
        part -= part.mean(axis=1, keepdims=True)
        size = np.round(np.abs(np.fft.rfft(part * window)), 2)
        for k, (low, high) in enumerate(BANDS):
            best = size[:, low:high].argmax(axis=1)
            out[at : at + BLOCK, k] = np.where(size[np.arange(len(part)), low + best] > 0, low + best, 0)
    return out


def pairs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, codes) in order of frame, distance and bands."""
    n, bands = found.shape
    frames, codes = [], []
    for gap in range(1, min(REACH, n - 1) + 1):
        a, b = np.repeat(found[:-gap], bands, axis=1), np.tile(found[gap:], (1, bands))
        code = (a << 12) | (b << 2) | gap
        at = np.repeat(np.arange(n - gap), bands * bands).reshape(code.shape)
        keep = (a > 0) & (b > 0)
        frames.append(at[keep])
        codes.append(code[keep])
    if not frames:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    frame, code = np.concatenate(frames), np.concatenate(codes)
    order = np.argsort(frame, kind="stable")
    return frame[order].astype(np.int32), code[order].astype(np.int32)


def store_media(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) as a table under ``path``, or in the shared folder."""
    base.arrow_limits(docs.sparkSession, rows=500)

    def run(batches):
        for batch in batches:
            data = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array([to_wav(pad(x)) for x in data], pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    return base.stored(base.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media", path)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def store_fingerprints(media: DataFrame, path: str | None = None) -> DataFrame:
    """One row per stored file, all of it from the bytes read back: the columns of DIGESTS,
    frames and pairs, the time-coded array of peak pair codes; as a table like the media's."""
    base.arrow_limits(media.sparkSession, rows=500)
    fields = [f.split() for f in DIGESTS.split(", ")]
    kinds = [pa.string() if t == "string" else pa.int64() for _, t in fields] + [pa.int64()]

    def run(batches):
        for batch in batches:
            rows, frames, codes = [], [], []
            for d, n, m in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                payload = from_wav(m)
                frame, code = pairs(peaks(payload))
                frames.append(frame)
                codes.append(code)
                rows.append((d, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), len(payload) // HOP - 1))
            ends = np.cumsum([0, *map(len, frames)]).astype(np.int32)
            flat = [np.concatenate(x) if x else np.zeros(0, np.int32) for x in (frames, codes)]
            listed = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in flat], ["frame", "code"]))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([*columns, listed], [*(n for n, _ in fields), "frames", "pairs"])

    found = media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"{DIGESTS}, frames long, pairs {PAIRS}")
    return base.stored(found, "fingerprints", path)


def media_digests(prints: DataFrame) -> DataFrame:
    """The columns of DIGESTS and ``feature``: the number of stored pairs and the SHA-256 of
    the (frame, code) array as little-endian 32-bit integers."""
    base.arrow_limits(prints.sparkSession, rows=500)
    names = [f.split()[0] for f in DIGESTS.split(", ")]

    def run(batches):
        for batch in batches:
            stored = batch.column("pairs")
            ends = np.cumsum([0, *stored.value_lengths().to_pylist()])
            flat = stored.flatten()
            codes = np.column_stack([flat.field(c).to_numpy() for c in ("frame", "code")]).astype("<i4")
            features = [f"{j - i}:{hashlib.sha256(codes[i:j].tobytes()).hexdigest()}" for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(features, pa.string())], [*names, "feature"])

    return prints.select(*names, "pairs").mapInArrow(run, f"{DIGESTS}, feature string")


def op4_media_columns(spark, sf_dir: str) -> DataFrame:
    return media_digests(store_fingerprints(store_media(base.table(spark, sf_dir, "documents"))))
