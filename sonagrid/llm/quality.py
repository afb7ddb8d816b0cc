"""Quality by compression: texts are compressed with a zstandard dictionary built from
good labelled text and with one built from bad, and the difference of the sizes, over
the size of the text, becomes a calibrated probability.

A text is cut into chunks that are compressed one by one, so that its own earlier parts
do not take the dictionary's place however long it is. A short text says little: its
difference is drawn towards the mean by ``PRIOR_BYTES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from sonagrid.llm import labelled, spans

CHUNK = 1024
DICTIONARY = 64 << 10
LEVEL = 3
PRIOR_BYTES = 128


class Model:
    """Two dictionaries, the mean difference and the calibration (slope, intercept)."""

    def __init__(self, good: bytes, bad: bytes, mean: float, scale: tuple[float, float]) -> None:
        self.good, self.bad, self.mean, self.scale = good, bad, mean, scale

    def compressors(self) -> list:
        out = []
        for data in (self.good, self.bad):
            words = zstandard.ZstdCompressionDict(data)
            words.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_dict_id=False))
        return out

    @staticmethod
    def gain(chunks: list[bytes], compressors: list) -> int:
        """Bytes that the good dictionary saves over the bad one."""
        good, bad = compressors
        return sum(len(bad.compress(c)) - len(good.compress(c)) for c in chunks)

    def difference(self, gain: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (gain + PRIOR_BYTES * self.mean) / (size + PRIOR_BYTES)

    def probability(self, gain: np.ndarray, size: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.difference(gain, size) + self.scale[1], -30, 30)))


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to select from: all of them serve
        return b"\n".join(samples)[-DICTIONARY:]


def chunks(text: bytes) -> list[bytes]:
    return [text[at : at + CHUNK] for at in range(0, len(text), CHUNK)]


def train(texts: list[tuple[bytes, int]]) -> Model:
    """Half of the documents make the dictionaries, the others calibrate."""
    rows = [(chunks(text), y) for text, y in texts]
    sides = [[c for k, (found, y) in enumerate(rows) if y == value and k % 2 == 0 for c in found] for value in (1, 0)]
    if not all(sides) or len({y for _, y in rows[1::2]}) < 2:
        share = sum(y for _, y in rows) / len(rows) if rows else 0.5
        return Model(b"", b"", 0.0, (0.0, float(np.log((share + 0.01) / (1.01 - share)))))
    model = Model(_dictionary(sides[0]), _dictionary(sides[1]), 0.0, (0.0, 0.0))
    tools = model.compressors()
    rest = rows[1::2]
    gain = np.array([model.gain(found, tools) for found, _ in rest], float)
    size = np.array([sum(map(len, found)) for found, _ in rest], float)
    model.mean = float(gain.sum() / max(1.0, size.sum()))
    slope, base = labelled.logistic(model.difference(gain, size)[:, None], np.array([y for _, y in rest]))
    model.scale = (float(slope), float(base))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = labelled.PER_CLASS) -> Model:
    """Trains on the whole texts of at most ``per_class`` labelled documents of each class."""
    return labelled.trained(labelled.sample(docs, labels, label, per_class), lambda texts, y: train(list(zip(texts, y, strict=True))))


def _scores(model: Model, tools: list, texts: pa.Array) -> np.ndarray:
    data, offsets = spans.column_bytes(texts)
    view = memoryview(np.ascontiguousarray(data))
    gain = [model.gain([view[at : min(b, at + CHUNK)] for at in range(a, b, CHUNK)], tools) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return model.probability(np.array(gain, float), np.diff(offsets).astype(float))


def _scored(sent, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        tools = model.compressors()
        for batch in batches:
            score = _scores(model, tools, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted. A null or empty text gets
    the score of the mean difference; repeated rows stay, null ids pass through (not held
    out), other columns are not looked at. Without labels of both classes every text gets
    the share of good labels, 0.5 without any."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    found = rows.mapInArrow(_scored(sent, threshold), "doc_id long, score double, predicted int")
    return found.select("doc_id", labelled.held_out().alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = sent.value.compressors()
        for batch in batches:
            yield batch.filter(pa.array(_scores(sent.value, tools, batch.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
