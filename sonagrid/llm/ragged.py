"""Distinct spans of a buffer, and arrays of variable-length items by index."""

from __future__ import annotations

import numpy as np
import pandas as pd

from sonagrid.llm import spans


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the span of ``a`` and that of ``b`` of the same size are equal, for each pair."""
    out = np.ones(len(sizes), bool)
    x, y = spans.eights(a), spans.eights(b)
    some = np.flatnonzero((sizes > 0) & (sizes <= spans.SHORT))
    for at in range(0, spans.SHORT, 8):
        some = some[sizes[some] > at]
        if not len(some):
            break
        over = np.uint64(8) * np.maximum(at + 8 - sizes[some], 0).astype(np.uint64)
        out[some] &= ((x[a_starts[some] + at] ^ y[b_starts[some] + at]) << over) == 0
    for k in np.flatnonzero(sizes > spans.SHORT).tolist():
        n = int(sizes[k])
        out[k] = np.array_equal(a[a_starts[k] : a_starts[k] + n], b[b_starts[k] : b_starts[k] + n])
    return out


def distinct(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of one span of each kind, kind of each span, hash of each kind) for spans of
    bytes, in the order of the first span. Spans of one hash are compared with the first of
    them; if ever one differs, its kind is found by its bytes and comes after the others."""
    hashes = spans.span_hash(codes, starts, ends)
    inverse, kinds = pd.factorize(hashes)
    inverse = inverse.astype(np.int64)
    index = np.flatnonzero(np.concatenate(([True], inverse[1:] > np.maximum.accumulate(inverse)[:-1]))[: len(inverse)])
    first = index[inverse]
    sizes = ends - starts
    equal = sizes == sizes[first]
    # up to 8 bytes, the hash tells spans of one size apart
    some = np.flatnonzero(equal & (sizes > 8) & (first != np.arange(len(first))))
    equal[some] = same_bytes(codes, starts[some], codes, starts[first[some]], sizes[some])
    if equal.all():
        return index, inverse, kinds
    known: dict[bytes, int] = {}
    more: list[int] = []
    for k in np.flatnonzero(~equal).tolist():
        piece = codes[starts[k] : ends[k]].tobytes()
        if piece not in known:
            known[piece] = len(kinds) + len(more)
            more.append(k)
        inverse[k] = known[piece]
    return np.concatenate((index, more)), inverse, np.concatenate((kinds, hashes[more]))


def take(values: np.ndarray, sizes: np.ndarray, picked: np.ndarray, begins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates the ``picked`` items, where item k is ``sizes[k]`` values from
    ``begins[k]`` (by default the items lie end to end); also returns the size of each."""
    if begins is None:
        begins = np.cumsum(sizes) - sizes
    counts = sizes[picked]
    if not len(picked):
        return values[:0], counts
    before = np.cumsum(counts) - counts
    return values[np.arange(int(counts.sum())) + np.repeat(begins[picked] - before, counts)], counts
