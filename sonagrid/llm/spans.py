"""Vectorised work on whole Arrow columns of UTF-8 text: words, hashes, windows.

Everything here takes the raw bytes of many texts at once, so that no Python loop
runs over words. Callers cut a batch into slices of a few MB (``slices``), which
bounds the memory of a task whatever the number of rows in an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2 << 20

_ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=np.uint64)
#: Spans up to so many bytes are worked on eight bytes at a time, all spans at once.
SHORT = 64


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def as_utf8(raw: bytes, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Texts laid end to end and their sizes. If they are not all UTF-8, each is put right by
    itself: bytes that stand in no character become U+FFFD."""
    try:
        raw.decode()
        if not (np.frombuffer(raw, np.uint8)[(np.cumsum(sizes) - sizes)[sizes > 0]] & 0xC0 == 0x80).any():
            return raw, sizes
    except UnicodeDecodeError:
        pass
    ends = np.cumsum(sizes).tolist()
    texts = [raw[b - n : b].decode("utf-8", "replace").encode() for b, n in zip(ends, sizes.tolist(), strict=True)]
    return b"".join(texts), np.array([len(x) for x in texts], np.int64)


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes together, or one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def cuts(text: bytes, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of one text, each cut after a space or line end, of about ``most`` bytes;
    longer where there is none."""
    at = 0
    while at < len(text):
        end = at + most
        if end < len(text):
            end = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end)) + 1
            if end <= at:
                after = [x for x in (text.find(b" ", at + most), text.find(b"\n", at + most)) if x >= 0]
                end = min(after) + 1 if after else len(text)
        yield at, min(end, len(text))
        at = end
    if not text:
        yield 0, 0


def word_spans(kept: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs where ``kept`` holds, never across rows or the places
    before which ``cuts`` holds, and the index of each row's first run (one more at the
    end)."""
    if not len(kept):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    cut = np.zeros(len(kept) + 1, bool)
    if cuts is not None:
        cut[:-1] = cuts
    cut[offsets] = True
    before = np.concatenate(([False], kept[:-1])) & ~cut[:-1]
    after = np.concatenate((kept[1:], [False])) & ~cut[1:]
    starts = np.flatnonzero(kept & ~before)
    ends = np.flatnonzero(kept & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data``, zeros beyond its end, as one number."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of ``data`` (bytes). Spans of one length up to 8 have
    different hashes if they differ."""
    sizes = ends - starts
    words = eights(data)
    out = sizes.astype(np.uint64) * _ODD[2]
    some = np.flatnonzero((sizes > 0) & (sizes <= SHORT))
    for at in range(0, SHORT, 8):
        if at:
            some = some[sizes[some] > at]
        if not len(some):
            break
        over = np.uint64(8) * np.maximum(at + 8 - sizes[some], 0).astype(np.uint64)
        out[some] = mix((out[some] * _ODD[at // 8]) ^ (words[starts[some] + at] << over))
    for k in np.flatnonzero(sizes > SHORT).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return out


def window_hash(words: np.ndarray, size: int, picked: tuple[int, ...] | None = None) -> np.ndarray:
    """A hash of each run of ``size`` words, or of the ``picked`` places in it."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(size), np.uint64)
    for k, at in enumerate(picked if picked is not None else range(size)):
        total += words[at : at + n] * (_ODD[k % 8] + np.uint64(2 * (k // 8)))
    return mix(total)


def byte_table(drop: bytes = b"", keep: bytes | None = None) -> np.ndarray:
    """A truth table over byte values: all but ``drop``, or only ``keep``."""
    table = np.ones(256, bool)
    if keep is not None:
        table[:] = False
        table[list(keep)] = True
    table[list(drop)] = False
    return table


#: A-Z to a-z; all other bytes stay.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Words of letters, digits and all bytes beyond ASCII, after lower-casing.
ALNUM = byte_table(keep=bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: Words between white space (space, \t, \n, \v, \f, \r).
NONSPACE = byte_table(drop=b" \t\n\x0b\x0c\r")
