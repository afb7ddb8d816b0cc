"""A bounded sample of labelled documents, and the calibration of a score."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Labelled documents of each class that a model is fitted on, at most.
PER_CLASS = 1500
#: Bytes of a class's sampled texts together, at most. A document is taken with its whole
#: text or not at all.
CLASS_BYTES = 32 << 20


def held_out(key: str = "doc_id") -> Column:
    """True for rows from which no label may be learnt."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, text: str = "text", key: str = "doc_id", class_bytes: int = CLASS_BYTES) -> DataFrame:
    """doc_id, whole text and label of at most ``per_class`` documents of each class whose rows are
    not held out, chosen by a hash of the id, as long as the texts
    of a class are ``class_bytes`` together. An id that is labelled both ways counts for
    neither class; of several texts of one id, the least is taken. A null text is empty. It is
    bounded by 2 * class_bytes."""
    rows = labels.filter(~held_out(key) & F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    order = F.xxhash64("doc_id")
    chosen = None
    for value in (0, 1):
        some = rows.filter(F.col("label") == value).orderBy(order, "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.union(some)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    # at most 2 * per_class rows of two numbers
    joined = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(b""))).alias("text"))
    # at most 2 * per_class rows
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("so_far", before).filter(F.col("so_far") <= class_bytes).drop("so_far")


def trained(rows: DataFrame, train: Callable[[list[bytes], list[int]], object]) -> object:
    """What ``train`` makes of a sample, in the order of a hash of the id. The sample is
    bounded, so one task takes it; only the model reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            y += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, y))], pa.binary())], ["model"])

    one = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("text", "label")
    found = one.mapInArrow(run, "model binary").first()
    return pickle.loads(found.model) if found else train([], [])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Coefficients of a logistic regression of ``y`` on the columns of ``x``; the
    intercept comes last. Newton steps on scaled columns with a small ridge."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-12
    z = np.column_stack(((x - mean) / spread, np.ones(len(x))))
    beta = np.zeros(z.shape[1])
    penalty = ridge * len(y) * np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(z.shape[1]), z.T @ (y - p) - penalty @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    slope = beta[:-1] / spread
    return np.append(slope, beta[-1] - slope @ mean)
