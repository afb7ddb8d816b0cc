"""Toxicity by averaged subword embeddings and a linear softmax.

A word is the bag of its character n-grams (with its ends marked) and itself, each
hashed to a row of an embedding table; a segment is the average of the rows of its
words; a softmax over two classes reads it. Table and softmax are trained together in
numpy on a bounded sample of labelled documents. As a misspelling shares most n-grams
with the word it hides, it is scored alike although it was never seen.

A document is labelled as a whole but may hold few toxic words, so training alternates:
the segments of a toxic document that score highest stand for it, and so do those of a
clean one. A text is scored by its highest segments, over its whole length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sonagrid.llm import labelled, ragged, spans
from sonagrid.llm.bpe import _LETTER, _NUMBER, _classes

GRAMS = (3, 4, 5)
BUCKET_BITS = 18
DIM = 16
SEGMENT_WORDS = 3
#: Bytes of text that are looked at together; a longer text is cut after white space.
SLICE_BYTES = 256 << 10
SEED = 7


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Code points in lower case; those outside words become 0."""
    table = np.arange(0x110000, dtype=np.uint32)
    kept = np.isin(_classes(), (_LETTER, _NUMBER))
    kept[[ord(c) for c in "*@$"]] = True
    for c in np.flatnonzero(kept).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    table[~kept] = 0
    return table


class _Marked:
    """The words of texts laid end to end, each with a mark before and after it."""

    def __init__(self, raw: bytes, sizes: np.ndarray) -> None:
        raw, sizes = spans.as_utf8(raw, sizes)
        data = np.frombuffer(raw, np.uint8)
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        codes = _folded()[points]
        #: ``first``: the first word of each text, one more at the end.
        starts, ends, self.first = spans.word_spans(codes > 0, np.searchsorted(heads, np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))))
        self.names = spans.span_hash(codes.view(np.uint8), starts * 4, ends * 4)  #: a number for each word
        self.whole = self.names >> np.uint64(64 - BUCKET_BITS)
        self.lengths = ends - starts + 2
        self.begins = np.cumsum(self.lengths) - self.lengths
        total = int(self.lengths.sum())
        self.codes = np.ones(total, np.uint64)
        inner = np.ones(total, bool)
        inner[self.begins] = inner[self.begins + self.lengths - 1] = False
        self.codes[inner] = codes[codes > 0]
        self.left = np.repeat(self.begins + self.lengths, self.lengths) - np.arange(total)

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length: the places where an n-gram starts, and its bucket."""
        rolling = self.codes * np.uint64(0x9E3779B97F4A7C15)
        for n in range(2, max(GRAMS) + 1):
            rolling = rolling[:-1] * np.uint64(0xD6E8FEB86659FD93) + self.codes[n - 1 :]
            if n in GRAMS:
                at = np.flatnonzero(self.left[: len(rolling)] >= n)
                yield at, (spans.mix(rolling[at]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def grams(raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: the buckets of all n-grams and words, the first of each
    word (one more at the end) and the first word of each text (one more at the end)."""
    marked = _Marked(raw, sizes)
    if not len(marked.begins):
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(len(sizes) + 1, np.int64)
    found, word = [marked.whole.astype(np.int64)], [np.arange(len(marked.begins))]
    for at, buckets in marked.grams():
        found.append(buckets)
        word.append(np.searchsorted(marked.begins, at, side="right") - 1)
    words = np.concatenate(word)
    order = np.argsort(words, kind="stable")
    return np.concatenate(found)[order], np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bincount(words, minlength=len(marked.begins))))), marked.first


def word_sums(weights: np.ndarray, raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: each word's summed weight and number of n-grams, and the
    first word of each text (one more at the end)."""
    marked = _Marked(raw, sizes)
    if not len(marked.begins):
        return np.zeros(0), np.zeros(0, np.int64), np.zeros(len(sizes) + 1, np.int64)
    here = np.zeros(len(marked.codes))
    count = np.ones(len(marked.begins), np.int64)
    for at, buckets in marked.grams():
        here[at] += weights[buckets]
    for n in GRAMS:
        count += np.maximum(marked.lengths - n + 1, 0)
    return np.add.reduceat(here, marked.begins) + weights[marked.whole.astype(np.int64)], count, marked.first


def _segments(value: np.ndarray, count: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The two features of each text from the sums and sizes of its words."""
    sums, many = (np.concatenate((np.zeros(1), np.cumsum(x, dtype=np.float64))) for x in (value, count))
    out = np.full((len(first) - 1, 2), -1.0)
    lead = np.arange(len(value))
    stop = np.minimum(lead + SEGMENT_WORDS, np.repeat(first[1:], np.diff(first)))
    mean = (sums[stop] - sums[lead]) / np.maximum(many[stop] - many[lead], 1)
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b > a:
            mine = mean[a : max(a + 1, b - SEGMENT_WORDS + 1)]
            top = int(mine.argmax())
            rest = np.concatenate((mine[: max(0, top - SEGMENT_WORDS + 1)], mine[top + SEGMENT_WORDS :]))
            out[k] = mine[top], rest.max() if len(rest) else mine[top]
    return out


@dataclass
class Model:
    weights: np.ndarray  #: for each bucket, its embedding read by the softmax's difference
    scale: tuple[float, float, float]  #: calibration: highest, second, intercept

    def features(self, raw: bytes, sizes: np.ndarray) -> np.ndarray:
        """For each text, the mean weight of its highest segment and of the highest that
        shares no word with it."""
        return _segments(*word_sums(self.weights, raw, sizes))

    def long_features(self, raw: bytes) -> np.ndarray:
        """The same for one text of any length."""
        parts = [word_sums(self.weights, raw[a:b], np.array([b - a])) for a, b in spans.cuts(raw, SLICE_BYTES)]
        value, count = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        return _segments(value, count, np.array([0, len(value)]))

    def score(self, raw: bytes, sizes: np.ndarray) -> np.ndarray:
        high, second, base = self.scale
        x = self.long_features(raw) if len(sizes) == 1 else self.features(raw, sizes)
        p = 1 / (1 + np.exp(-np.clip(high * x[:, 0] + second * x[:, 1] + base, -30, 30)))
        return np.where(sizes == 0, 0.0, p)


def _sgd(bags: np.ndarray, ends: np.ndarray, y: np.ndarray, table: np.ndarray, soft: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Adagrad over segments (bags of buckets); updates ``table`` and ``soft`` in place."""
    begins = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
    seen_table, seen_soft = np.full((len(table), 1), 1e-8, np.float32), np.full(soft.shape, 1e-8, np.float32)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 512):
            rows = order[at : at + 512]
            counts = ends[rows] - begins[rows]
            row = np.repeat(np.arange(len(rows)), counts)
            picked = bags[np.arange(int(counts.sum())) + np.repeat(begins[rows] - np.cumsum(counts) + counts, counts)]
            cut = np.cumsum(counts) - counts
            mean = np.add.reduceat(table[picked], cut, axis=0) / counts[:, None]
            logits = mean @ soft
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= weight[rows, None] / len(rows)
            to_soft, to_mean = mean.T @ p, (p @ soft.T) / counts[:, None]
            by = np.argsort(picked, kind="stable")
            buckets, heads = np.unique(picked[by], return_index=True)
            to_table = np.add.reduceat(to_mean[row[by]], heads, axis=0)
            seen_table[buckets] += (to_table**2).mean(axis=1, keepdims=True)
            table[buckets] -= 0.3 * to_table / np.sqrt(seen_table[buckets])
            seen_soft += to_soft**2
            soft -= 0.1 * to_soft / np.sqrt(seen_soft)


class _Corpus:
    """The words of some texts: the buckets of each distinct word, end to end (``buckets``,
    ``sizes``), the words of all texts by number (``ids``) and the first of each text, one
    more at the end (``first``). Texts are read ``SLICE_BYTES`` at a time."""

    def __init__(self, texts: list[bytes]) -> None:
        known: dict[int, int] = {}
        buckets, sizes, ids = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        words = np.zeros(len(texts), np.int64)
        for group in self._groups(texts):
            raw = b"".join(texts[k][a:b] for k, a, b in group)
            lengths = np.array([b - a for _, a, b in group])
            found, of_word, first = grams(raw, lengths)
            names = _Marked(raw, lengths).names.tolist()
            before = len(known)
            number = np.fromiter((known.setdefault(x, len(known)) for x in names), np.int32, len(names))
            new = np.flatnonzero(number >= before)
            new = new[np.unique(number[new], return_index=True)[1]]
            values, counts = ragged.take(found.astype(np.int32), np.diff(of_word), new, of_word[:-1])
            buckets.append(values)
            sizes.append(counts)
            ids.append(number)
            np.add.at(words, [k for k, _, _ in group], np.diff(first))
        self.buckets, self.sizes, self.ids = np.concatenate(buckets), np.concatenate(sizes), np.concatenate(ids)
        self.first = np.concatenate((np.zeros(1, np.int64), np.cumsum(words)))

    @staticmethod
    def _groups(texts: list[bytes]) -> Iterator[list[tuple[int, int, int]]]:
        group: list[tuple[int, int, int]] = []
        held = 0
        for k, text in enumerate(texts):
            for a, b in spans.cuts(text, SLICE_BYTES):
                if group and held + b - a > SLICE_BYTES:
                    yield group
                    group, held = [], 0
                group.append((k, a, b))
                held += b - a
        if group:
            yield group

    def means(self, weights: np.ndarray, lead: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The mean weight of the n-grams of each run of words."""
        of_word = np.add.reduceat(weights[self.buckets], np.cumsum(self.sizes) - self.sizes)
        sums, many = (np.concatenate((np.zeros(1), np.cumsum(x[self.ids], dtype=np.float64))) for x in (of_word, self.sizes))
        return (sums[stop] - sums[lead]) / np.maximum(many[stop] - many[lead], 1)

    def bags(self, lead: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of some runs of words, end to end, and the end of each run)."""
        words, _ = ragged.take(self.ids, stop - lead, np.arange(len(lead)), lead)
        values, sizes = ragged.take(self.buckets, self.sizes, words)
        return values, np.cumsum(sizes)[np.cumsum(stop - lead) - 1]


#: Segments of the sampled texts that the first round is fitted on, about; later rounds take
#: the highest segments of every text, and this share of the other segments of clean ones.
FIRST_SEGMENTS, CLEAN_SHARE = 60_000, 0.1


def train(texts: list[bytes], y: np.ndarray, rounds: int = 4, epochs: int = 3) -> Model:
    """Fits the model; two thirds of the texts fit the embeddings, the rest calibrates."""
    rng = np.random.default_rng(SEED)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), (0.0, 0.0, 6.0 if y.sum() else -6.0))
    fit = np.arange(len(y)) % 3 != 2
    corpus, target = _Corpus([t for t, f in zip(texts, fit, strict=True) if f]), y[fit]
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    soft = rng.uniform(-1, 1, (DIM, 2)).astype(np.float32)
    ends = corpus.first[1:]
    runs = -(-np.diff(corpus.first) // SEGMENT_WORDS)
    text_of = np.repeat(np.arange(len(runs)), runs)
    lead = corpus.first[text_of] + SEGMENT_WORDS * (np.arange(len(text_of)) - np.repeat(np.cumsum(runs) - runs, runs))
    stop = np.minimum(lead + SEGMENT_WORDS, ends[text_of])
    for k in range(rounds if len(lead) else 0):
        if k:
            value = corpus.means((table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), lead, stop)
            order = np.lexsort((-value, text_of))
            rank = np.arange(len(order)) - np.searchsorted(text_of[order], text_of[order])
            some = order[(rank < 2) | (target[text_of[order]] == 0) & ((rank < 6) | (rng.random(len(order)) < CLEAN_SHARE))]
        else:
            some = np.flatnonzero(rng.random(len(lead)) < min(1.0, FIRST_SEGMENTS / len(lead)))
        if len(some):
            _sgd(*corpus.bags(lead[some], stop[some]), target[text_of[some]], table, soft, epochs, rng)
    # too few texts to calibrate: the share of toxic ones
    model = Model((table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), (0.0, 0.0, float(np.log(y.mean() / (1 - y.mean())))))
    x = np.concatenate([model.long_features(t) for t, f in zip(texts, fit, strict=True) if not f] or [np.zeros((0, 2))])
    if len(set(y[~fit].tolist())) == 2:
        model.scale = tuple(float(v) for v in labelled.logistic(x, y[~fit]))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = labelled.PER_CLASS) -> Model:
    """Trains on the whole texts of at most ``per_class`` labelled documents of each class."""
    return labelled.trained(labelled.sample(docs, labels, label, per_class), lambda texts, y: train(texts, np.array(y, np.int64)))


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    data, offsets = spans.column_bytes(texts)
    parts = [model.score(data[offsets[a] : offsets[b]].tobytes(), np.diff(offsets[a : b + 1])) for a, b in spans.slices(offsets, SLICE_BYTES)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _scored(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _scores(model.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted. A null or empty text
    scores 0; bytes that are not UTF-8 count as U+FFFD; one without words scores as its calibration says for none; repeated rows
    stay, null ids pass through (not held out), other columns are not looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    found = rows.mapInArrow(_scored(sent, threshold), "doc_id long, score double, predicted int")
    return found.select("doc_id", labelled.held_out().alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(sent.value, batch.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)
