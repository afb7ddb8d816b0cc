"""Structured Streaming forms of the ingest operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sonagrid.operators.ingest import EXPECTED_SEC, GAP_ALERT_SEC

#: Fixed value: how late a chunk may be.
LATE = "2 minutes"


def read_stream(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int = 100) -> DataFrame:
    """Files of a folder as a stream; ``per_trigger`` bounds what is taken at once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def event_time(rows: DataFrame, column: str) -> DataFrame:
    """Watermarks need a timestamp with a time zone."""
    return rows.withColumn(column, F.col(column).cast("timestamp"))


def idempotent(chunks: DataFrame, late: str = LATE) -> DataFrame:
    """First of each (device, seq) within the watermark."""
    return chunks.withWatermark("ended_at", late).dropDuplicatesWithinWatermark(["device_id", "seq"])


def activity(rows: DataFrame, time: str = "window_start_ts", every: str = "1 hour", late: str = LATE) -> DataFrame:
    """Detections by species in tumbling windows."""
    return rows.withWatermark(time, late).groupBy(F.window(time, every), "species_slug").agg(F.count("*").alias("cnt")).select(F.col("window.start").alias("start"), "species_slug", "cnt")


def analysis_windows(samples: DataFrame, time: str = "ts", late: str = LATE) -> DataFrame:
    """Sliding windows of five seconds every two and a half."""
    return samples.withWatermark(time, late).groupBy("device_id", F.window(time, "5 seconds", "2500 milliseconds")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def sessions(chunks: DataFrame, gap: str = "180 seconds", late: str = LATE) -> DataFrame:
    """Spells of continuous observation of each device."""
    return chunks.withWatermark("started_at", late).groupBy("device_id", F.session_window("started_at", gap)).agg(F.count("*").alias("chunks"))


def heartbeat(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("device_id").agg(F.max("seq").alias("last_seq"), F.max("started_at").alias("last_started_at"))


_TIMING = T.StructType().add("id", "long").add("device_id", "long").add("overlap_sec", "double").add("gap_sec", "double").add("gap_event", "boolean").add("out_of_order", "boolean")
_TIMING_STATE = T.StructType().add("devices", T.ArrayType(T.LongType())).add("starts", T.ArrayType(T.DoubleType())).add("ends", T.ArrayType(T.DoubleType()))
#: Keys share state in so many buckets, since a call for each key costs more than its rows.
BUCKETS = 2048


def _bucket(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("bucket")


def _plain(column: pd.Series) -> list:
    """Values of a column, None for nulls."""
    return column.astype("Int64").astype(object).where(column.notna(), None).tolist() if column.hasnans else column.tolist()


def chunk_timing(chunks: DataFrame, expected_sec: float = EXPECTED_SEC, alert_sec: float = GAP_ALERT_SEC) -> DataFrame:
    """Timing of each chunk against the latest-started one before it; the state of a bucket
    holds that chunk's start and end for each device. Triggers have to come in order of
    arrival."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {d: (s, e) for d, s, e in zip(*state.get, strict=True)} if state.exists else {}
        out = []
        # one bucket's rows of one trigger, which maxFilesPerTrigger bounds
        rows = pd.concat(list(frames)).sort_values(["arrival", "id"])
        for i, device, s, e in zip(rows["id"].tolist(), _plain(rows["device_id"]), rows["s"].tolist(), rows["e"].tolist(), strict=True):
            start, end = known.get(device, (float("nan"), float("nan")))
            late = s < start
            lead = 0.0 if late or start != start else end - s
            gap = max(0.0, -lead)
            out.append((i, device, max(0.0, lead), gap, gap > max(1.5 * expected_sec, alert_sec), late))
            if not late:
                known[device] = (s, e)
        state.update((list(known), [x[0] for x in known.values()], [x[1] for x in known.values()]))
        yield pd.DataFrame(out, columns=_TIMING.names).astype({"device_id": "Int64"})

    rows = chunks.select("id", "device_id", "arrival", *[F.col(c).cast("double").alias(c[0]) for c in ("started_at", "ended_at")], _bucket("device_id"))
    return rows.groupBy("bucket").applyInPandasWithState(run, _TIMING, _TIMING_STATE, "append", GroupStateTimeout.NoTimeout)


_SEAM = T.StructType().add("id", "long").add("device_id", "long").add("species_slug", "string").add("duplicate_of_id", "long")
_SEAM_STATE = T.StructType().add("devices", T.ArrayType(T.LongType())).add("slugs", T.ArrayType(T.StringType())).add("ids", T.ArrayType(T.LongType())).add("starts", T.ArrayType(T.DoubleType())).add("ends", T.ArrayType(T.DoubleType()))


def seam_dedup(detections: DataFrame, least: float = 0.5, late: str = "7 days") -> DataFrame:
    """Marks each detection with the first canonical one that it overlaps. The state of a
    bucket holds, for each (device, species) in it, canonical spans that ended at the watermark
    or later, which are all that rows within ``late`` of the newest can overlap."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bound = state.getCurrentWatermarkMs() / 1000
        held = [x for x in zip(*state.get, strict=True) if x[4] >= bound] if state.exists else []
        lives: dict[tuple, list] = {}
        for d, slug, *span in held:
            lives.setdefault((d, slug), []).append(span)
        out = []
        rows = pd.concat(list(frames)).sort_values(["s", "id"])
        slugs = rows["species_slug"].astype(object).where(rows["species_slug"].notna(), None).tolist()
        for i, d, slug, s, e in zip(rows["id"].tolist(), _plain(rows["device_id"]), slugs, rows["s"].tolist(), rows["e"].tolist(), strict=True):
            of = None
            live = lives[d, slug] = [x for x in lives.get((d, slug), ()) if x[2] >= s]  # the rows of a trigger come by start
            for other, s0, e0 in live:
                shorter = min(e - s, e0 - s0)
                shared = max(0.0, min(e, e0) - max(s, s0))
                if (shared / shorter if shorter > 0 else float(min(e, e0) >= max(s, s0))) >= least:
                    of = other
                    break
            out.append((i, d, slug, of))
            if of is None:
                held.append((d, slug, i, s, e))
                live.append((i, s, e))
        state.update(tuple(map(list, zip(*held, strict=True))) or ([], [], [], [], []))
        yield pd.DataFrame(out, columns=_SEAM.names).astype({"device_id": "Int64", "duplicate_of_id": "Int64"})

    seconds = [F.col(f"window_{k}_ts").cast("double").alias(k[0]) for k in ("start", "end")]
    rows = detections.withWatermark("window_start_ts", late).select("id", "device_id", "species_slug", "window_start_ts", *seconds, _bucket("device_id", "species_slug"))
    return rows.groupBy("bucket").applyInPandasWithState(run, _SEAM, _SEAM_STATE, "append", GroupStateTimeout.NoTimeout)


def detection_sink(path: str, raw_path: str | None = None, on_batch: Callable[[DataFrame, int], None] | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """Writes a micro-batch to the part of a table that has its number (and a raw copy if
    asked), then calls ``on_batch``, for alerts or automatic batches. A batch that comes
    again after a failure takes the place of what it wrote before. ``prepare`` is called for
    each micro-batch, so that a registry which it reads is read anew each time."""

    def sink(batch: DataFrame, number: int) -> None:
        batch = prepare(batch) if prepare else batch
        several = raw_path or on_batch
        if several:
            batch = batch.persist()  # it is computed once for all that follows
        for folder in filter(None, (path, raw_path)):
            batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if on_batch:
            on_batch(batch, number)
        if several:
            batch.unpersist()

    return sink


def whitelisted(registry: Callable[[], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Keeps the detections of species that the registry has when it is called."""
    return lambda batch: batch.join(F.broadcast(registry().select(F.col("slug").alias("species_slug")).distinct()), "species_slug", "left_semi").select(batch.columns)  # a registry has a few hundred rows


def write_detections(stream: DataFrame, path: str, checkpoint: str, raw_path: str | None = None, on_batch: Callable[[DataFrame, int], None] | None = None):
    """Starts a query that hands each micro-batch to ``detection_sink``; the table has a
    partition column ``batch``."""
    return stream.writeStream.foreachBatch(detection_sink(path, raw_path, on_batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
