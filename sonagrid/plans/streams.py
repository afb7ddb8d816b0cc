"""Streaming forms run to the end of a table (rows-only: SQL has no counterpart)."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sonagrid.plans.registry import query
from sonagrid.sources import fixtures as fx
from sonagrid.streaming import exports, pipelines, watch


def _in_order(spark: SparkSession, folder: str) -> None:
    """Streams take files by their time of change: that of the parts follows their names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    parts = sorted((f.getPath() for f in files.listStatus(path)), key=lambda x: x.getName())
    now = int(time.time()) * 1000
    for k, part in enumerate(x for x in parts if x.getName().startswith("part-")):
        files.setTimes(part, now - 1000 * (len(parts) - k), -1)


def _fed(spark: SparkSession, frame: DataFrame, order: tuple[str, ...] = (), per_trigger: int = 100) -> tuple[DataFrame, str]:
    """(``frame`` as a stream, by ``order`` if it matters; a folder for what it writes)."""
    from sonagrid.sources.shared import shared_folder

    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if order:
        frame = frame.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    frame.write.parquet(f"{folder}/in")
    if order:
        _in_order(spark, f"{folder}/in")
    return pipelines.read_stream(spark, f"{folder}/in", frame.schema, per_trigger), folder


def _run(spark: SparkSession, frame: DataFrame, build, mode: str = "append", order: tuple[str, ...] = (), per_trigger: int = 100) -> DataFrame:
    """What a stream has written when ``frame`` has run out, with the number of the
    micro-batch."""
    stream, folder = _fed(spark, frame, order, per_trigger)
    out = build(stream)

    # a batch that comes again takes the place of what it wrote before
    sink = pipelines.detection_sink(f"{folder}/out")
    with watch.state_store(spark):
        out.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*out.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(f"{folder}/out")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.chunks(spark, sf_dir)
    for c in ("started_at", "ended_at"):
        rows = pipelines.event_time(rows, c)
    return rows


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.detections(spark, sf_dir)
    for c in ("window_start_ts", "window_end_ts"):
        rows = pipelines.event_time(rows, c)
    return rows


@query()
def stream_ingest_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, _chunks(spark, sf_dir), lambda s: pipelines.idempotent(s, "60 days").select("id", "device_id", "seq")).drop("batch")


@query()
def stream_chunk_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, _chunks(spark, sf_dir), pipelines.chunk_timing, order=("arrival", "id")).drop("batch")


@query()
def stream_seam_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, _detections(spark, sf_dir), pipelines.seam_dedup, order=("window_start_ts", "id")).drop("batch")


@query("SELECT device_id, max(seq) AS last_seq, max(started_at) AS last_started_at FROM chunks GROUP BY 1", ("chunks",))
def stream_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trigger gives the devices that it has news of; the last news counts."""
    news = _run(spark, _chunks(spark, sf_dir), pipelines.heartbeat, "update")
    last = news.groupBy("device_id").agg(F.max_by(F.struct("last_seq", "last_started_at"), "batch").alias("m"))
    return last.select("device_id", "m.last_seq", F.col("m.last_started_at").cast("timestamp_ntz").alias("last_started_at"))


def _closed(table: str, time: str, end: str) -> str:
    """What has ended when the watermark stands two minutes before the last row."""
    return f"{end} <= (SELECT max({time}) - INTERVAL 2 MINUTES FROM {table})"


@query("SELECT date_trunc('hour', window_start_ts)::TIMESTAMP AS start, species_slug, count(*) AS cnt FROM detections GROUP BY 1, 2", ("detections",))
def stream_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hour, those too that the watermark has not closed: each trigger gives the counts
    that it changes, and the last one counts."""
    news = _run(spark, _detections(spark, sf_dir), pipelines.activity, "update", order=("window_start_ts", "id"))
    last = news.groupBy("start", "species_slug").agg(F.max_by("cnt", "batch").alias("cnt"))
    return last.withColumn("start", F.col("start").cast("timestamp_ntz"))


_SPELL = "(SELECT device_id, started_at, sum(new) OVER (PARTITION BY device_id ORDER BY started_at, id) AS spell FROM (SELECT *, CASE WHEN started_at < lag(started_at) OVER (PARTITION BY device_id ORDER BY started_at, id) + INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new FROM chunks))"


@query(f"SELECT * FROM (SELECT device_id, min(started_at) AS start, max(started_at) + INTERVAL 12 HOURS AS finish, count(*) AS chunks FROM {_SPELL} GROUP BY device_id, spell) WHERE {_closed('chunks', 'started_at', 'finish')}", ("chunks",))
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spells of a device's chunks less than twelve hours apart, once they are over."""
    rows = _run(spark, _chunks(spark, sf_dir), lambda s: pipelines.sessions(s, "12 hours"), order=("started_at", "id"))
    return rows.select("device_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("finish"), "chunks")


@query(f"SELECT * FROM (SELECT user_id AS device_id, make_timestamp((epoch_us(ts) // 2500000 - k) * 2500000) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events, range(2) t(k) GROUP BY 1, 2) WHERE {_closed('events', 'ts', 'start + INTERVAL 5 SECONDS')}")
def stream_analysis_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of five seconds every two and a half, once they are over."""
    rows = fx.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("device_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    found = _run(spark, rows, pipelines.analysis_windows, order=("ts", "event_id"))
    return found.select("device_id", F.col("window.start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 6).alias("mean"))


@query(f"""SELECT device_id, started_at AS last_seen_at, limit_sec FROM (
  SELECT c.device_id, started_at, greatest(1.5 * coalesce(expected_chunk_sec, 60), 180)::DOUBLE AS limit_sec, coalesce(lead(started_at) OVER (PARTITION BY c.device_id ORDER BY started_at), (SELECT max(started_at) - INTERVAL 2 MINUTES FROM chunks)) AS until
  FROM chunks c JOIN devices d ON d.device_id = c.device_id WHERE is_active) WHERE epoch_us(until) - epoch_us(started_at) > limit_sec * 1000000""", ("chunks", "devices"))
def stream_stale_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences told by timers, up to the watermark at the end of the table."""
    devices = fx.devices(spark, sf_dir).select("device_id", "is_active", "expected_chunk_sec")
    found = _run(spark, _chunks(spark, sf_dir), lambda s: watch.silences(s, devices), order=("started_at", "id"))
    return found.select("device_id", F.col("last_seen_at").cast("timestamp_ntz").alias("last_seen_at"), "limit_sec")


@query("SELECT id FROM (SELECT id, count(*) OVER (PARTITION BY device_id, kind ORDER BY epoch(started_at)::BIGINT RANGE BETWEEN 36000 PRECEDING AND 1 PRECEDING) AS n FROM (SELECT id, device_id, date_trunc('second', started_at) AS started_at, seq % 2 AS kind FROM chunks)) WHERE n = 0", ("chunks",))
def stream_record_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event of a device and kind in ten hours, by state that expires."""
    events = _chunks(spark, sf_dir).select("id", "device_id", (F.col("seq") % 2).alias("kind"), "started_at")
    return _run(spark, events, lambda s: watch.suppress_repeats(s, 36_000), order=("started_at", "id")).select("id")


@query("SELECT id, user_id, (r - 1) // 40 AS export, (r - 1) % 40 + 1 AS place FROM (SELECT id, user_id, row_number() OVER (ORDER BY id) AS r, count(*) OVER () AS n FROM submissions WHERE status = 'pending') WHERE (r - 1) // 40 < n // 40", ("submissions",))
def stream_auto_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting submissions, exported forty at a time as soon as so many wait."""
    rows = fx.submissions(spark, sf_dir).filter("status = 'pending'").select("id", "user_id")
    stream, folder = _fed(spark, rows, ("id",))
    stream.writeStream.foreachBatch(exports.auto_batch(f"{folder}/out", 40)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*rows.schema.fields, T.StructField("export", T.LongType()), T.StructField("place", T.LongType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(f"{folder}/out/export").drop("batch")
