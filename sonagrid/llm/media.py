"""Media columns: WAV bytes, short-time Fourier transform, peak-pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sonagrid.llm import spans

RATE = 8000
UNIT = 192
FRAME, HOP = 192, 96
#: Frames transformed together, which bounds memory for a long signal.
BLOCK = 4096
#: The bins of each band in which a frame has one peak.
BANDS = ((1, 8), (8, 24), (24, 97))
_WINDOW = np.hanning(FRAME).astype(np.float32)


def write_wav(samples: bytes, rate: int = RATE) -> bytes:
    """``samples`` as a mono 8-bit WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(samples)
    return out.getvalue()


def read_wav(data: bytes) -> tuple[int, bytes]:
    """(rate, samples) of a mono 8-bit WAV file."""
    with wave.open(io.BytesIO(data), "rb") as f:
        if (f.getnchannels(), f.getsampwidth()) != (1, 1):
            raise ValueError("only mono 8-bit files are read")
        return f.getframerate(), f.readframes(f.getnframes())


def spectral_peaks(samples: np.ndarray) -> Iterator[np.ndarray]:
    """Blocks of (frames, bands): the strongest bin of each band of each frame."""
    if len(samples) < FRAME:
        return
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for at in range(0, len(frames), BLOCK):
        x = (frames[at : at + BLOCK].astype(np.float32) - 128) * _WINDOW
        power = np.abs(np.fft.rfft(x, axis=1))
        yield np.stack([lo + power[:, lo:hi].argmax(axis=1) for lo, hi in BANDS], axis=1)


def fingerprints(samples: np.ndarray) -> np.ndarray:
    """Time-coded peak pairs: frame << 24 | bin << 16 | later bin << 8 | pair kind, for
    each band of a frame with the same and the next band of the frame after it."""
    blocks = list(spectral_peaks(samples))
    if not blocks:
        return np.zeros(0, np.int64)
    peaks = np.concatenate(blocks).astype(np.int64)
    n = len(peaks) - 1
    if n < 1:
        return (peaks[0] << 16) | np.arange(len(BANDS))
    time = np.arange(n, dtype=np.int64) << 24
    pairs = [time | peaks[:-1, b] << 16 | peaks[1:, (b + d) % len(BANDS)] << 8 | (2 * b + d) for b in range(len(BANDS)) for d in (0, 1)]
    return np.stack(pairs, axis=1).reshape(-1)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_fingerprints", pa.int64()), ("wav", pa.binary()), ("fingerprints", pa.list_(pa.int64()))])


def feature_of(marks: np.ndarray) -> str:
    """The eight commonest peak pairs, each with its count and the frame it first comes in."""
    kinds, first, counts = np.unique(marks & 0xFFFFFF, return_index=True, return_counts=True)
    top = np.lexsort((kinds, -counts))[:8]
    return ",".join(f"{kinds[i]:06x}:{counts[i]}@{marks[first[i]] >> 24}" for i in top)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = spans.column_bytes(batch.column(1))
        for lo, hi in spans.slices(offsets):
            rows = []
            for k in range(lo, hi):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                stored = write_wav(text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT)))
                _, payload = read_wav(stored)
                marks = fingerprints(np.frombuffer(payload, np.uint8))
                rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(marks), len(marks), stored, marks))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(list(x), _OUT.field(k + 1).type) for k, x in enumerate(columns))], schema=_OUT)


def describe(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: the UTF-8 bytes of the text, padded with spaces to a positive
    multiple of 192, stored as a WAV file and read back; sizes, digests, ``feature`` (the
    eight commonest peak pairs, their counts and first frames), the file and its time-coded
    fingerprints.

    A null or empty text is 192 spaces; equal texts give equal values; repeated rows
    stay, null ids pass through, other columns are not looked at. A long text is
    transformed in blocks of frames."""
    kind = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_fingerprints long, wav binary, fingerprints array<long>"
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(_described, kind)
