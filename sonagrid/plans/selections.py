"""Scans, filters, sorts and limits (inventory 2.1, 2.3, 2.7)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from sonagrid.functions import time
from sonagrid.operators import dataset, filters
from sonagrid.operators.filters import ObservationFilter
from sonagrid.plans.registry import query
from sonagrid.sources import fixtures as fx

AS_OF = datetime(2024, 1, 20)
COLS = ["id", "device_id", "species_slug", "confidence", "window_start_ts"]
_COLS = ", ".join(COLS)
_LOC = "lat IS NOT NULL"


def _filtered(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return ObservationFilter(**options).apply(fx.detections(spark, sf_dir)).select(*COLS)


def _add(name: str, where: str, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _filtered(spark, sf_dir, **options)

    run.__name__ = name
    query(f"SELECT {_COLS} FROM detections WHERE {where}", ("detections",))(run)


_add("src_detections", "TRUE", require_location=False)
_add("flt_species", f"species_slug IN ('click', 'view') AND {_LOC}", species=["click", "view"])
_add("flt_from", f"window_start_ts >= TIMESTAMP '2024-01-10' AND {_LOC}", start=datetime(2024, 1, 10))
_add("flt_to", f"window_start_ts <= TIMESTAMP '2024-01-10' AND {_LOC}", end=datetime(2024, 1, 10))
_add("flt_device", f"device_id IN (1, 2, 3) AND {_LOC}", devices=[1, 2, 3])
_add("flt_min_conf", f"confidence >= 0.6 AND {_LOC}", min_confidence=0.6)
_add("flt_hours", f"hour(window_start_ts) IN (1, 5, 23) AND {_LOC}", hours=[25, 5, 23, -1])
_add("flt_not_duplicate", f"duplicate_of_id IS NULL AND {_LOC}")
_add("flt_located", _LOC)
_add("flt_bbox", "lat BETWEEN 59.9101 AND 59.9301 AND lon BETWEEN 41.1101 AND 41.1401", bbox=(41.1101, 59.9101, 41.1401, 59.9301))
_DIST = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(lat - 59.92) / 2), 2) + cos(radians(lat)) * cos(radians(59.92)) * pow(sin(radians(lon - 41.13) / 2), 2))))"
_add("flt_radius", f"{_LOC} AND {_DIST} <= 1234.5", center=(59.92, 41.13), radius_m=1234.5)


@query("SELECT is_empty FROM (VALUES (1, TRUE), (2, TRUE), (3, FALSE)) t(n, is_empty)")
def flt_is_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [ObservationFilter(), ObservationFilter(min_confidence=0.0), ObservationFilter(hours=[3])]
    return spark.createDataFrame([(f.is_empty(),) for f in found], "is_empty boolean")


@query("SELECT slug FROM (VALUES ('CHINA'), ('ATLANTIS')) t(slug) WHERE slug NOT IN (SELECT slug FROM registry)", ("registry",))
def flt_unknown_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([("CHINA",), ("ATLANTIS",)], "slug string")
    return filters.unknown_species(asked, fx.registry(spark, sf_dir)).select("slug")


@query("SELECT id FROM detections WHERE window_start_ts >= TIMESTAMP '2024-01-18' AND window_start_ts <= TIMESTAMP '2024-01-19 23:59:59.999999'", ("detections",))
def flt_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonagrid.functions.time import parse_bound

    rows = fx.detections(spark, sf_dir)
    return rows.filter((F.col("window_start_ts") >= parse_bound(F.lit("2024-01-18"))) & (F.col("window_start_ts") <= parse_bound(F.lit("2024-01-19"), upper=True))).select("id")


@query("SELECT id FROM detections WHERE window_start_ts >= TIMESTAMP '2024-01-18'", ("detections",))
def flt_hours_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.recent(fx.detections(spark, sf_dir), AS_OF, 48).select("id")


@query("SELECT slug FROM registry WHERE habitat = 'asia'", ("registry",))
def flt_habitat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.registry(spark, sf_dir).filter("habitat = 'asia'").select("slug")


@query("SELECT id, status FROM submissions WHERE status IN ('pending', 'accepted')", ("submissions",))
def flt_active_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.submissions(spark, sf_dir).filter(F.col("status").isin("pending", "accepted")).select("id", "status")


@query("SELECT id FROM detections WHERE epoch_ms(window_start_ts) BETWEEN 1704844800000 AND 1705017600000", ("detections",))
def flt_date_range_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = time.epoch_ms("window_start_ts")
    return fx.detections(spark, sf_dir).filter(ms.between(1704844800000, 1705017600000)).select("id")


@query("SELECT id FROM (SELECT id, id % 3 AS sync_status FROM detections) WHERE sync_status = 0", ("detections",))
def flt_pending_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.detections(spark, sf_dir).withColumn("sync_status", F.col("id") % 3).filter("sync_status = 0").select("id")


@query("SELECT user_id FROM (SELECT user_id, consent, user_id % 500 AS age FROM users) WHERE consent AND age <= 365", ("users",))
def flt_consent_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = fx.users(spark, sf_dir).withColumn("consented_at", F.lit(AS_OF).cast("timestamp") - F.make_dt_interval((F.col("user_id") % 500).cast("int"), F.lit(7)))
    return filters.consent_valid(users, AS_OF, 365).select("user_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority <= '2-HIGH' AND o_orderpriority >= '1'")
def flt_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "orders").withColumn("q", F.translate(F.left("o_orderpriority", F.lit(1)), "12345", "ABCDE"))
    return filters.quality_at_least(rows, "B").select("o_orderkey")


@query(
    """SELECT id, CASE WHEN dur <= 0 THEN 'not_positive' WHEN dur < 20 THEN 'too_short' WHEN dur > 90 THEN 'too_long' WHEN started_at + to_seconds(CAST(dur AS BIGINT)) < TIMESTAMP '2024-01-20' - INTERVAL 120 SECONDS THEN 'too_old'
    WHEN started_at > TIMESTAMP '2024-01-20' + INTERVAL 300 SECONDS THEN 'ahead' END AS reason FROM (SELECT id, started_at, id % 100 - 2 AS dur FROM chunks)""",
    ("chunks",),
)
def flt_chunk_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.chunks(spark, sf_dir).withColumn("ended_at", F.col("started_at") + F.make_dt_interval(secs=(F.col("id") % 100 - 2).cast("decimal(18,6)")))
    return rows.select("id", filters.chunk_rejection(F.lit(AS_OF)).alias("reason"))


@query("SELECT device_id, name FROM devices WHERE is_active ORDER BY name", ("devices",))
def src_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.devices(spark, sf_dir).filter("is_active").select("device_id", "name").orderBy("name")


@query("SELECT device_id, name, is_active, device_type FROM devices WHERE device_id = 7", ("devices",))
def src_device_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.devices(spark, sf_dir).filter("device_id = 7").select("device_id", "name", "is_active", "device_type")


@query("SELECT * FROM (VALUES ('anas', 'Duck', 'wetland'), ('strix', 'Owl', 'forest')) t(slug, ru, habitat)")
def src_registry_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonagrid.sources.files import registry_from_json

    text = spark.createDataFrame([('{"anas": {"ru": "Duck", "habitat": "wetland"}, "strix": {"ru": "Owl", "habitat": "forest"}}',)], "value string")
    return registry_from_json(text)


@query("SELECT id, status, user_id FROM submissions WHERE id IN (1, 3, 7)", ("submissions",))
def src_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.submissions(spark, sf_dir).filter(F.col("id").isin(1, 3, 7)).select("id", "status", "user_id")


@query("SELECT id, species_slug FROM detections ORDER BY window_start_ts DESC, id DESC LIMIT 50", ("detections",))
def src_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.detections(spark, sf_dir).orderBy(F.desc("window_start_ts"), F.desc("id")).limit(50).select("id", "species_slug")


@query(f"SELECT {_COLS} FROM detections WHERE {_LOC} ORDER BY window_start_ts, id LIMIT 300", ("detections",))
def topk_scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, limit=300)


@query(f"SELECT count(*) >= 300 AS truncated FROM detections WHERE {_LOC}", ("detections",))
def topk_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, limit=300).agg((F.count("*") >= 300).alias("truncated"))


@query("SELECT id, species_slug, window_start_ts FROM detections WHERE window_start_ts >= TIMESTAMP '2024-01-18' ORDER BY window_start_ts DESC, id DESC LIMIT 25", ("detections",))
def topk_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.recent(fx.detections(spark, sf_dir), AS_OF, 48).orderBy(F.desc("window_start_ts"), F.desc("id")).limit(25).select("id", "species_slug", "window_start_ts")


@query("SELECT species_slug, count(*) AS cnt FROM detections GROUP BY 1 ORDER BY cnt DESC, species_slug LIMIT 10", ("detections",))
def topk_species10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.detections(spark, sf_dir).groupBy("species_slug").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "species_slug").limit(10)


@query(f"SELECT id, lat, lon FROM (SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, window_start_ts FROM detections WHERE {_LOC} ORDER BY window_start_ts, id LIMIT 50000)", ("detections",))
def topk_points_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ObservationFilter(limit=50_000).apply(fx.detections(spark, sf_dir)).select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("SELECT user_id, count(*) FILTER (WHERE status = 'accepted') AS accepted, count(*) AS total FROM submissions GROUP BY 1 ORDER BY accepted DESC, total DESC, user_id LIMIT 20", ("submissions",))
def topk_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fx.submissions(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("status") == "accepted").alias("accepted"), F.count("*").alias("total"))
    return g.orderBy(F.desc("accepted"), F.desc("total"), "user_id").limit(20)


@query("SELECT user_id, max(id) AS id FROM submissions WHERE status IN ('pending', 'accepted') GROUP BY 1", ("submissions",))
def topk_last_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.submissions(spark, sf_dir).filter(F.col("status").isin("pending", "accepted")).groupBy("user_id").agg(F.max_by("id", "id").alias("id"))


@query("SELECT id, user_id FROM submissions WHERE status = 'pending' ORDER BY id LIMIT 100", ("submissions",))
def topk_batch_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.submissions(spark, sf_dir).filter("status = 'pending'").orderBy("id").limit(100).select("id", "user_id")


@query('SELECT "class", recording_id, file FROM (SELECT *, row_number() OVER (PARTITION BY "class" ORDER BY file) AS r FROM recordings) WHERE r <= 5', ("recordings",))
def topk_per_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.first_per_key(fx.recordings(spark, sf_dir), "class", ["file"], 5)


@query("SELECT slug, ru FROM registry ORDER BY lower(ru), ru LIMIT 6 OFFSET 6", ("registry",))
def topk_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.page(fx.registry(spark, sf_dir), 1).select("slug", "ru")


@query("SELECT id, device_id FROM chunks WHERE device_id = 5 ORDER BY started_at DESC, id DESC LIMIT 20", ("chunks",))
def topk_device_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.chunks(spark, sf_dir).filter("device_id = 5").orderBy(F.desc("started_at"), F.desc("id")).limit(20).select("id", "device_id")


@query("SELECT id, device_id FROM chunks WHERE started_at >= TIMESTAMP '2024-01-19' AND started_at < TIMESTAMP '2024-01-20' ORDER BY started_at DESC, id DESC LIMIT 50", ("chunks",))
def topk_gap_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.chunks(spark, sf_dir).filter((F.col("started_at") >= F.lit("2024-01-19").cast("timestamp_ntz")) & (F.col("started_at") < F.lit(AS_OF).cast("timestamp_ntz")))
    return rows.orderBy(F.desc("started_at"), F.desc("id")).limit(50).select("id", "device_id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 20")
def topk_job_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.submissions(spark, sf_dir).filter("status = 'pending'").orderBy("created_at", "id").limit(20).select("id")
