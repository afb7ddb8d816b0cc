"""Chunk protocol, device states, gaps and de-duplication in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sonagrid.functions.time import between_sec, device_state, seconds
from sonagrid.operators import scan, sweep

#: Fixed values of the protocol, in seconds.
EXPECTED_SEC, GAP_ALERT_SEC = 60.0, 180.0


def gap_required(gap_sec: Column, interval_sec: Column, alert_sec: float = GAP_ALERT_SEC) -> Column:
    """A gap is reported beyond one and a half intervals and the alert time, strictly."""
    return gap_sec > F.greatest(1.5 * interval_sec, F.lit(alert_sec))


def chunk_timing(chunks: DataFrame, devices: DataFrame | None = None, expected_sec: float = EXPECTED_SEC, alert_sec: float = GAP_ALERT_SEC) -> DataFrame:
    """Each chunk against the latest-started one that came before it: overlap, gap,
    gap_event, out_of_order, prev_id. Chunks come in by (arrival, id)."""
    last = F.struct(F.col("started_at").alias("s"), F.col("id").alias("i"), F.col("ended_at").alias("e"))
    rows = scan.running(chunks, ["device_id"], ["arrival", "id"], {"prev": ("max", last)})
    if devices is not None:
        rows = rows.join(devices.select("device_id", "expected_chunk_sec"), "device_id", "left")
        interval = F.coalesce("expected_chunk_sec", F.lit(expected_sec))
    else:
        interval = F.lit(expected_sec)
    lead = F.coalesce(between_sec(F.col("prev.e"), "started_at"), F.lit(0.0))
    late = F.coalesce(F.col("started_at") < F.col("prev.s"), F.lit(False))
    overlap = F.when(late, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), lead))
    gap = F.when(late, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), -lead))
    return rows.select(*[c for c in chunks.columns], F.col("prev.i").alias("prev_id"), F.col("prev.e").alias("prev_ended_at"), late.alias("out_of_order"), overlap.alias("overlap_sec"), gap.alias("gap_sec"), gap_required(gap, interval, alert_sec).alias("gap_event"))


def gap_events(timing: DataFrame) -> DataFrame:
    """One event for each reported gap, from the end of one chunk to the next start."""
    return timing.filter("gap_event").select(F.col("id").alias("chunk_id"), "device_id", F.lit("gap").alias("kind"), F.col("prev_ended_at").alias("started_at"), F.col("started_at").alias("ended_at"), F.col("gap_sec").alias("duration_sec"))


def state_events(reports: DataFrame) -> DataFrame:
    """An event for each report (device_id, at, id, is_active) that differs from the
    device's report before: deactivated or reactivated."""
    rows = scan.running(reports, ["device_id"], ["at", "id"], {"before": ("max", F.struct("at", "id", "is_active"))})
    kind = F.when(F.col("is_active"), "reactivated").otherwise("deactivated")
    return rows.filter("is_active <> before.is_active").select("device_id", kind.alias("kind"), F.col("at").alias("started_at"), F.lit(None).cast("double").alias("duration_sec"))


def error_events(jobs: DataFrame, attempts: int = 2) -> DataFrame:
    """An event for each failed job (device_id, at, attempts, failed) that was tried so often."""
    return jobs.filter(F.col("failed") & (F.col("attempts") >= attempts)).select("device_id", F.lit("error").alias("kind"), F.col("at").alias("started_at"), F.lit(None).cast("double").alias("duration_sec"))


def device_events(gaps: DataFrame, states: DataFrame, errors: DataFrame) -> DataFrame:
    """device_id, kind, started_at, duration_sec of all three kinds of events."""
    return gaps.select("device_id", "kind", "started_at", "duration_sec").unionByName(states).unionByName(errors)


def overlap_zone(timing: DataFrame) -> DataFrame:
    """Start and end, in seconds, of the part of a chunk that its predecessor has too."""
    start = seconds("started_at")
    size = F.least("overlap_sec", between_sec("ended_at", "started_at"))
    none = F.col("overlap_sec") <= 0
    return timing.withColumn("zone_start", F.when(none, F.lit(0.0)).otherwise(start)).withColumn("zone_end", F.when(none, F.lit(0.0)).otherwise(start + size))


def idempotent(chunks: DataFrame) -> DataFrame:
    """Re-sent chunks: verdict accepted, resent (same digest) or conflict, by comparison
    with the first of the same device and sequence number."""
    order = Window.partitionBy("device_id", "seq").orderBy("arrival", "id")
    first = F.first("sha256").over(order)
    rank = F.row_number().over(order)
    return chunks.withColumn("verdict", F.when(rank == 1, "accepted").when(F.col("sha256") == first, "resent").otherwise("conflict"))


def heartbeat(chunks: DataFrame) -> DataFrame:
    """Per device the largest sequence number and the latest start and end."""
    return chunks.groupBy("device_id").agg(F.max("seq").alias("last_seq"), F.max("started_at").alias("last_started_at"), F.max("ended_at").alias("last_ended_at"), F.count("*").alias("chunks"))


def heartbeat_so_far(chunks: DataFrame) -> DataFrame:
    """Adds seq_so_far and start_so_far, the heartbeat of the device as each chunk came in."""
    rows = scan.running(chunks, ["device_id"], ["arrival", "id"], {"_seq": ("max", F.col("seq")), "_start": ("max", F.col("started_at"))})
    return rows.withColumn("seq_so_far", F.greatest("seq", "_seq")).withColumn("start_so_far", F.greatest("started_at", "_start")).drop("_seq", "_start")


def device_states(devices: DataFrame, as_of: Column, expected_sec: float = EXPECTED_SEC) -> DataFrame:
    interval = F.coalesce("expected_chunk_sec", F.lit(expected_sec))
    return devices.withColumn("silence_sec", between_sec(as_of, "last_seen_at")).withColumn("state", device_state("last_seen_at", as_of, interval))


def stale_devices(devices: DataFrame, as_of: Column, expected_sec: float = EXPECTED_SEC, alert_sec: float = GAP_ALERT_SEC) -> DataFrame:
    """Active devices that were seen and are silent for longer than a gap may be."""
    rows = device_states(devices, as_of, expected_sec)
    interval = F.coalesce("expected_chunk_sec", F.lit(expected_sec))
    return rows.filter("is_active and last_seen_at is not null").filter(gap_required(F.col("silence_sec"), interval, alert_sec)).select("device_id", "name", "last_seen_at", "silence_sec")


def silences(chunks: DataFrame, devices: DataFrame, as_of: Column, expected_sec: float = EXPECTED_SEC, alert_sec: float = GAP_ALERT_SEC) -> DataFrame:
    """device_id, last_seen_at, limit_sec: each silence of an active device up to ``as_of``
    that is longer than a gap may be, whether it has ended or not."""
    known = devices.filter("is_active").select("device_id", F.coalesce("expected_chunk_sec", F.lit(expected_sec)).alias("interval"))
    after = F.lead("started_at").over(Window.partitionBy("device_id").orderBy("started_at"))
    rows = chunks.join(known, "device_id").withColumn("until", F.coalesce(after, as_of)).withColumn("limit_sec", F.greatest(1.5 * F.col("interval"), F.lit(alert_sec)))
    return rows.filter(between_sec("until", "started_at") > F.col("limit_sec")).select("device_id", F.col("started_at").alias("last_seen_at"), "limit_sec")


def suppress_repeats(events: DataFrame, within_sec: int = 3600) -> DataFrame:
    """Events without one of the same device and kind in the time before."""
    order = Window.partitionBy("device_id", "kind").orderBy(F.unix_seconds(F.col("started_at").cast("timestamp"))).rangeBetween(-within_sec, -1)
    return events.withColumn("earlier", F.count("*").over(order)).filter("earlier = 0").drop("earlier")


def gap_report(stale: DataFrame, events: DataFrame) -> DataFrame:
    """Silent devices and recent gap events in one frame."""
    a = stale.select("device_id", F.lit("stale").alias("kind"), F.col("silence_sec").alias("duration_sec"))
    return a.unionByName(events.select("device_id", "kind", "duration_sec"))


def islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers the runs of intervals (s, e) that touch, as island; runs never overlap each
    other. The rows of a key are told apart by (s, id)."""
    heavy = scan.heavy_keys(rows, keys)
    rows = scan.running(rows, keys, ["s", "id"], {"reach": ("max", F.col("e"))}, heavy)
    rows = rows.withColumn("new", F.when(F.col("s") < F.col("reach"), 0).otherwise(1)).drop("reach")
    rows = scan.running(rows, keys, ["s", "id"], {"island": ("sum", F.col("new"))}, heavy)
    return rows.withColumn("island", F.col("island") + F.col("new")).drop("new")


def at_seam(detections: DataFrame, zones: DataFrame, margin_sec: float = 1.0) -> DataFrame:
    """Adds at_seam to detections with a chunk_id: whether the span touches the part of its
    chunk that the chunk's predecessor has too, give or take ``margin_sec``. ``zones`` is
    ``overlap_zone`` of the chunks; the inside of a chunk holds no duplicates."""
    z = zones.select(F.col("id").alias("chunk_id"), "zone_start", "zone_end")
    touches = (F.col("zone_end") > F.col("zone_start")) & (seconds("window_start_ts") < F.col("zone_end") + margin_sec) & (seconds("window_end_ts") > F.col("zone_start") - margin_sec)
    return detections.join(z, "chunk_id", "left").withColumn("at_seam", F.coalesce(touches, F.lit(False))).drop("zone_start", "zone_end")


def mark_duplicates(detections: DataFrame, least: float = 0.5, keys: tuple[str, ...] = ("device_id", "species_slug"), may: str | None = None) -> DataFrame:
    """id, duplicate_of_id: in the order of (start, id) a detection is a duplicate of the
    first canonical one that it overlaps by ``least`` of the shorter interval. Duplicates
    absorb nothing. ``may`` names a boolean column (as of ``at_seam``): where it is not true,
    a detection is canonical whatever it overlaps.

    Groups are cut first into runs of overlapping intervals, between which nothing can
    match; a sweep goes through each with the canonical spans that are still open."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = detections.select(*keys, "id", micros("window_start_ts").alias("s"), micros("window_end_ts").alias("e"), (F.coalesce(F.col(may), F.lit(False)) if may else F.lit(True)).alias("may"))
    # an interval without length touches what ends where it begins
    runs = islands(rows.withColumn("until", F.col("e")).withColumn("e", F.col("e") + 1), list(keys)).withColumn("e", F.col("until"))
    return sweep.first_match(runs, keys, least, absorbing=True).withColumnRenamed("of_id", "duplicate_of_id")


def storage_kept(files: DataFrame, limit_bytes: int) -> DataFrame:
    """Files that stay when the oldest go until the total is within a limit. The running
    total is made by day first, so no single task sees all files."""
    by_day = files.withColumn("day", F.to_date("mtime"))
    totals = by_day.groupBy("day").agg(F.sum("size").alias("size"))
    newer = totals.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    order = Window.partitionBy("day").orderBy(F.desc("mtime"), F.desc("id"))
    rows = by_day.join(newer, "day").withColumn("upto", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter(F.col("upto") <= limit_bytes).drop("day", "before", "upto")


def retained(rows: DataFrame, as_of: Column, most: int, ttl_sec: float, key: str = "device_id", time: str = "created_at") -> DataFrame:
    """The newest ``most`` rows of each key that are not older than ``ttl_sec``."""
    order = Window.partitionBy(key).orderBy(F.desc(time), F.desc("id"))
    return rows.withColumn("_r", F.row_number().over(order)).filter((F.col("_r") <= most) & (between_sec(as_of, time) <= ttl_sec)).drop("_r")
