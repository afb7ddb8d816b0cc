"""A minimal perfect hash of distinct 32-bit keys, with the keys beside it.

Keys fall into a bitmap; those alone in their cell stay there, the others go to the next
level with another hash and a bitmap of their own. The hash of a key is the number of set
bits before its own, over all levels, so that n keys have the hashes 0 to n - 1. A directory
holds the set bits before every 64-bit word. The keys are kept in the order of their hashes:
a look-up compares them, so that a key that is not in the table is told apart."""

from __future__ import annotations

import numpy as np

from sonagrid.llm import spans

#: Cells of a level for each key that comes to it.
SPARE = 2
_HEAD = "<u8"


def _cells(keys: np.ndarray, level: int, cells: int) -> np.ndarray:
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return ((spans.mix(keys.astype(np.uint64) ^ seed) >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)


def _words(keys: np.ndarray) -> int:
    return max(1, -(-len(keys) * SPARE // 64))


def build(keys: np.ndarray) -> bytes:
    """The table of distinct ``keys``, as bytes."""
    left, maps = keys.astype(np.uint32), []
    while len(left):
        words = _words(left)
        at = _cells(left, len(maps), 64 * words)
        alone = np.bincount(at, minlength=64 * words) == 1
        maps.append(np.packbits(alone, bitorder="little").view(np.uint64))
        rest = left[~alone[at]]
        if len(rest) == len(left) and len(maps) > 200:
            raise ValueError("keys are not distinct")
        left = rest
    head = np.array([len(keys), len(maps), *(len(m) for m in maps)], _HEAD)
    bare = head.tobytes() + b"".join(m.tobytes() for m in maps)
    ordered = np.empty(len(keys), np.uint32)
    ordered[Table(bare + bytes(4 * len(keys)))._hash(keys)[0]] = keys
    return bare + ordered.tobytes()


class Table:
    """Look-ups in what ``build`` made."""

    def __init__(self, raw: bytes) -> None:
        many, levels = np.frombuffer(raw, _HEAD, 2)
        self.sizes = np.frombuffer(raw, _HEAD, int(levels), 16).astype(np.int64)
        at = 16 + 8 * int(levels)
        self.bits = np.frombuffer(raw, np.uint64, int(self.sizes.sum()), at)
        self.keys = np.frombuffer(raw, np.uint32, int(many), at + self.bits.nbytes)
        self.before = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)))

    def __len__(self) -> int:
        return len(self.keys)

    def _hash(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each key, whether a level has taken it in)."""
        out, open_, base = np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
        for level, words in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            at = _cells(keys[open_], level, 64 * words)
            word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
            found = (self.bits[word] >> bit & np.uint64(1)).astype(bool)
            below = self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[found]] = self.before[word[found]] + np.bitwise_count(below[found])
            open_, base = open_[~found], base + words
        taken = np.ones(len(keys), bool)
        taken[open_] = False
        return out, taken

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The hash of each key; an error if one is not in the table."""
        at, taken = self._hash(keys)
        if len(keys) and not (taken.all() and np.array_equal(self.keys[at], keys)):
            raise KeyError("a key is not in the table")
        return at
