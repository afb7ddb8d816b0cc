"""Watching devices in streams: silences by timers, repeated events by state that expires.

Both keep a few numbers for each key, in Spark's state store. Silences forget a key's state by a
timer in event time and need the RocksDB state store (``state_store``); repeated events share
calls and states in buckets, as a call for each key costs more than its rows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sonagrid.operators.ingest import EXPECTED_SEC, GAP_ALERT_SEC
from sonagrid.streaming.pipelines import LATE, _bucket, _plain

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside use the RocksDB state store, which timers need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


_SEEN = T.StructType().add("seen", "long").add("limit", "long").add("told", "boolean")
_SILENCE = T.StructType().add("device_id", "long").add("last_seen_us", "long").add("limit_us", "long")


class _Silences(StatefulProcessor):
    """A timer for each device at the end of the time that it may be silent. A chunk that comes
    in time moves the timer; one that comes later finds the silence told, or tells it, so that
    it makes no difference how many triggers the chunks come in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", _SEEN)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows))  # one device's rows of a trigger
        order = np.argsort(came["seen_us"].to_numpy(), kind="stable")
        seen, limit = came["seen_us"].to_numpy()[order], came["limit_us"].to_numpy()[order]
        if self.state.exists():
            last, allowed, told = self.state.get()
            later = seen > last
            seen, limit = np.concatenate(([last], seen[later])), np.concatenate(([allowed], limit[later]))
            self.handle.deleteTimer(_due_ms(last, allowed))
        else:
            told = False
        silent = np.flatnonzero(np.diff(seen) > limit[:-1])
        if told:
            silent = silent[silent > 0]
        if len(silent):
            yield _silences(key, seen[silent], limit[silent])
        told = bool(told and len(seen) == 1)
        self.state.update((int(seen[-1]), int(limit[-1]), told))
        if not told:
            self.handle.registerTimer(_due_ms(int(seen[-1]), int(limit[-1])))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last, allowed, told = self.state.get()
        if not told and _due_ms(last, allowed) == expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((last, allowed, True))
            yield _silences(key, np.array([last]), np.array([allowed]))

    def close(self) -> None:
        pass


def _due_ms(seen: int, limit: int) -> int:
    """The first millisecond after the time that a device may be silent."""
    return (seen + limit) // 1000 + 1


def _silences(key: Any, seen: np.ndarray, limit: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"device_id": key[0], "last_seen_us": seen, "limit_us": limit}).astype("int64")


def silences(chunks: DataFrame, devices: DataFrame, seen: str = "started_at", expected_sec: float = EXPECTED_SEC, alert_sec: float = GAP_ALERT_SEC, late: str = LATE) -> DataFrame:
    """device_id, last_seen_at, limit_sec: one row for each silence of an active device that
    is longer than a gap may be. It is given when the watermark passes the limit, or when a
    chunk ends the silence, whichever comes first. Chunks of unknown devices are left out;
    those that come later than ``late`` change nothing."""
    known = devices.filter("is_active").select("device_id", F.coalesce("expected_chunk_sec", F.lit(expected_sec)).alias("interval"))
    limit = (F.greatest(1.5 * F.col("interval"), F.lit(alert_sec)) * 1_000_000).cast("long")
    rows = chunks.withWatermark(seen, late).join(known, "device_id").select("device_id", seen, F.unix_micros(seen).alias("seen_us"), limit.alias("limit_us"))
    found = rows.groupBy("device_id").transformWithStateInPandas(_Silences(), _SILENCE, "Append", "EventTime")
    return found.select("device_id", F.timestamp_micros("last_seen_us").alias("last_seen_at"), (F.col("limit_us") / 1_000_000).alias("limit_sec"))


_NEVER = -(1 << 62)


def _values(column: pd.Series) -> list:
    """Values of a column, None for nulls; a column of integers with nulls comes as floats."""
    return _plain(column) if pd.api.types.is_float_dtype(column) else column.astype(object).where(column.notna(), None).tolist()


def _spell_ms(last: np.ndarray, within: int) -> np.ndarray:
    """The first millisecond whose events do not repeat one of second ``last``."""
    return 1000 * (last + within + 1)


def suppress_repeats(events: DataFrame, within_sec: int = 3600, time: str = "started_at", late: str = LATE) -> DataFrame:
    """Events without one of the same device and kind in the time before, as the batch form
    has it. The state of a bucket holds the last two seconds with an event of each device and
    kind in it, and forgets them ``within_sec`` after the last. Events without a time are left
    out."""
    schema = events.schema
    keys = [T.StructField(f"{c}s", T.ArrayType(schema[c].dataType)) for c in ("device_id", "kind")]
    held = T.StructType([*keys, *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("lasts", "befores")]])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        came = pd.concat(list(frames))  # one bucket's rows of one trigger
        devices, kinds, lasts, befores = state.get if state.exists else ([], [], [], [])
        number = {pair: k for k, pair in enumerate(zip(devices, kinds, strict=True))}
        of = [number.setdefault(pair, len(number)) for pair in zip(_values(came["device_id"]), _values(came["kind"]), strict=True)]
        old = np.arange(len(lasts))
        # every second with an event that is known of, by device and kind
        owner = np.concatenate((old, old, np.array(of, np.int64)))
        second = np.concatenate((np.array(befores, np.int64), np.array(lasts, np.int64), came["at_second"].to_numpy(np.int64)))
        known, place = np.unique(np.column_stack((owner, second)), axis=0, return_inverse=True)
        same = np.concatenate(([False], known[1:, 0] == known[:-1, 0]))
        earlier = np.where(same, np.concatenate(([_NEVER], known[:-1, 1])), _NEVER)
        place = place.reshape(-1)[2 * len(old) :]
        first = came[earlier[place] < known[place, 1] - within_sec]

        ends = np.flatnonzero(np.concatenate((~same[1:], [True])))
        due = _spell_ms(known[ends, 1], within_sec)
        live = due > state.getCurrentWatermarkMs()
        if live.any():
            pairs = list(number)
            kept = [pairs[k] for k in known[ends, 0][live].tolist()]
            state.update(([d for d, _ in kept], [x for _, x in kept], known[ends, 1][live].tolist(), earlier[ends][live].tolist()))
            state.setTimeoutTimestamp(int(due[live].max()))
        elif state.exists:
            state.remove()
        if len(first):
            yield first[schema.names].reset_index(drop=True)

    rows = events.filter(F.col(time).isNotNull()).withWatermark(time, late).withColumn("at_second", F.unix_seconds(time))
    # a column with nulls comes as floats, so keys with a null have a bucket of their own
    rows = rows.withColumn("bucket", F.when(F.col("device_id").isNull() | F.col("kind").isNull(), -1).otherwise(_bucket("device_id", "kind")))
    return rows.groupBy("bucket").applyInPandasWithState(run, schema, held, "append", GroupStateTimeout.EventTimeTimeout)
