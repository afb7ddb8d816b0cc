"""Directly addressable codes: an array of ids with access to any of them.

An id is cut into chunks of 8 bits, lowest first. Level k holds the k-th chunk of every
id that has one, with a bitmap that says which of them go on at the next level and a
directory of the ones before each block of 512 bits. So an id is found with one rank
a level, and no block is decoded.

Layout: ``DAC1``, levels (u1), then for each level its number of chunks (u8), the
chunks, the bitmap (bytes, low bit first) and the directory (u8 each). All numbers are
little-endian. The last level has no bitmap or directory.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"DAC1"
BLOCK = 512


def encode(ids: np.ndarray) -> bytes:
    left = np.asarray(ids, np.uint64)
    levels = []
    while True:
        more = left > 255
        chunks = (left & np.uint64(255)).astype(np.uint8).tobytes()
        if not more.any():
            levels.append(np.array([len(left)], "<u8").tobytes() + chunks)
            break
        bits = np.packbits(more, bitorder="little").tobytes()
        ranks = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.add.reduceat(more.astype(np.int64), np.arange(0, len(more), BLOCK)))))[:-1]
        levels.append(np.array([len(left)], "<u8").tobytes() + chunks + bits + ranks.astype("<u8").tobytes())
        left = left[more] >> np.uint64(8)
    return MAGIC + bytes([len(levels)]) + b"".join(levels)


class Codes:
    """Reads ``encode``'s bytes in place."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a DAC1 array")
        self.levels = []
        at, count = 5, data[4]
        for k in range(count):
            n = int(np.frombuffer(data, "<u8", 1, at)[0])
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            bits = ranks = None
            if k < count - 1:
                bits = np.frombuffer(data, np.uint8, -(-n // 8), at)
                at += len(bits)
                ranks = np.frombuffer(data, "<u8", -(-n // BLOCK), at)
                at += 8 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(level: tuple, i: int) -> int:
        """Ones before bit ``i``."""
        _, bits, ranks = level
        if i >= len(level[0]):
            block = len(ranks) - 1
        else:
            block = i // BLOCK
        inside = np.unpackbits(bits[block * BLOCK // 8 : -(-i // 8)], bitorder="little")[: i - block * BLOCK]
        return int(ranks[block]) + int(inside.sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, level in enumerate(self.levels):
            chunks, bits, _ = level
            value |= int(chunks[i]) << (8 * k)
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(level, i)
        return value

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """Ids ``lo`` up to ``hi``; reads only their own chunks."""
        return self._slice(0, lo, hi).astype(np.uint32)

    def _slice(self, k: int, lo: int, hi: int) -> np.ndarray:
        chunks, bits, _ = level = self.levels[k]
        values = chunks[lo:hi].astype(np.uint64)
        if bits is not None and hi > lo:
            first = lo // 8
            more = np.unpackbits(bits[first : -(-hi // 8)], bitorder="little")[lo - 8 * first : hi - 8 * first].astype(bool)
            if n := int(more.sum()):
                start = self._rank(level, lo)
                values[more] |= self._slice(k + 1, start, start + n) << np.uint64(8)
        return values
