"""Joins, windows, set operations, ingest protocol and states (2.2, 2.4, 2.6, 2.8, 2.11, 2.13)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sonagrid.operators import aggregates, export, ingest, joins, states, zones
from sonagrid.plans.registry import query
from sonagrid.sources import fixtures as fx

_D = ("detections",)


def _species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of the event types."""
    return spark.createDataFrame([("click", "Click", "wetland"), ("view", "View", "forest"), ("error", "Error", "urban")], "slug string, ru string, habitat string")


_SPECIES = "(VALUES ('click', 'Click', 'wetland'), ('view', 'View', 'forest'), ('error', 'Error', 'urban')) r(slug, ru, habitat)"


@query(f"SELECT r.slug, r.ru, r.habitat, coalesce(s.cnt, 0) AS cnt, s.last_seen FROM {_SPECIES} LEFT JOIN (SELECT species_slug, count(*) AS cnt, max(window_start_ts) AS last_seen FROM detections WHERE species_slug <> 'error' GROUP BY 1) s ON s.species_slug = r.slug", _D)
def join_catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = aggregates.species_summary(fx.detections(spark, sf_dir).filter("species_slug <> 'error'")).select("species_slug", "cnt", "last_seen")
    return joins.catalog_summary(_species(spark, sf_dir), stats)


@query(f"SELECT d.id, d.species_slug, coalesce(r.ru, d.species_slug) AS ru, coalesce(r.habitat, 'other') AS habitat FROM detections d LEFT JOIN {_SPECIES} ON r.slug = d.species_slug", _D)
def join_species_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.with_species_name(fx.detections(spark, sf_dir), _species(spark, sf_dir)).select("id", "species_slug", "ru", "habitat")


@query("SELECT d.id, d.device_id, coalesce(v.name, d.device_id::VARCHAR) AS name FROM detections d LEFT JOIN devices v ON v.device_id = d.device_id", ("detections", "devices"))
def join_device_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.with_device_name(fx.detections(spark, sf_dir), fx.devices(spark, sf_dir)).select("id", "device_id", "name")


@query("SELECT d.id, d.device_id, round(CASE WHEN v.device_type = 'mobile' THEN d.lat ELSE v.lat END, 6) AS lat, round(CASE WHEN v.device_type = 'mobile' THEN d.lon ELSE v.lon END, 6) AS lon FROM detections d LEFT JOIN devices v ON v.device_id = d.device_id", ("detections", "devices"))
def join_device_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joins.with_location(fx.detections(spark, sf_dir), fx.devices(spark, sf_dir))
    return rows.select("id", "device_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


_PAIRS = """SELECT b.id, a.id AS of_id, b.device_id, b.species_slug, a.window_start_ts AS of_start, round((epoch_us(least(a.window_end_ts, b.window_end_ts)) - epoch_us(greatest(a.window_start_ts, b.window_start_ts))) / 43200000000.0, 6) AS fraction
  FROM detections a JOIN detections b ON a.device_id = b.device_id AND a.species_slug = b.species_slug AND (a.window_start_ts < b.window_start_ts OR a.window_start_ts = b.window_start_ts AND a.id < b.id) AND a.window_end_ts > b.window_start_ts"""


@query(f"SELECT id, of_id, device_id, species_slug, fraction FROM ({_PAIRS})", _D)
def join_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.overlapping_pairs(fx.detections(spark, sf_dir))


@query(f"SELECT id, of_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY of_start, of_id) AS r FROM ({_PAIRS}) WHERE fraction >= 0.5) WHERE r = 1", _D)
def join_dup_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.first_overlap(fx.detections(spark, sf_dir))


_HAV = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(f"SELECT a.species_slug, a.day, a.id, b.id AS other FROM (SELECT *, date_trunc('day', window_start_ts) AS day FROM detections WHERE lat IS NOT NULL) a JOIN (SELECT *, date_trunc('day', window_start_ts) AS day FROM detections WHERE lat IS NOT NULL) b ON a.species_slug = b.species_slug AND a.day = b.day AND a.id <> b.id WHERE {_HAV} <= 321.7", _D)
def join_eps_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.detections(spark, sf_dir).filter("lat is not null").withColumn("day", F.date_trunc("day", "window_start_ts").cast("timestamp_ntz"))
    return joins.neighbours(rows, 321.7, ["species_slug", "day"])


_TIMING = """SELECT c.*, p.i AS prev_id, p.e AS prev_ended_at, coalesce(c.started_at < p.s, FALSE) AS out_of_order,
    CASE WHEN p.i IS NULL OR c.started_at < p.s THEN 0 ELSE greatest(0, epoch(p.e) - epoch(c.started_at)) END::DOUBLE AS overlap_sec,
    CASE WHEN p.i IS NULL OR c.started_at < p.s THEN 0 ELSE greatest(0, epoch(c.started_at) - epoch(p.e)) END::DOUBLE AS gap_sec
  FROM (SELECT *, max({'s': started_at, 'i': id, 'e': ended_at}) OVER (PARTITION BY device_id ORDER BY arrival, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM chunks) c"""
_FULL = f"SELECT t.*, gap_sec > greatest(1.5 * coalesce(v.expected_chunk_sec, 60), 180) AS gap_event FROM ({_TIMING}) t LEFT JOIN devices v ON v.device_id = t.device_id"


@query(f"SELECT id, device_id, prev_id, out_of_order, round(overlap_sec, 3) AS overlap_sec, round(gap_sec, 3) AS gap_sec, gap_event FROM ({_FULL})", ("chunks", "devices"))
def str_chunk_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ingest.chunk_timing(fx.chunks(spark, sf_dir), fx.devices(spark, sf_dir))
    return t.select("id", "device_id", "prev_id", "out_of_order", F.round("overlap_sec", 3).alias("overlap_sec"), F.round("gap_sec", 3).alias("gap_sec"), "gap_event")


@query(f"SELECT id, prev_id FROM ({_TIMING})", ("chunks",))
def join_prev_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.chunk_timing(fx.chunks(spark, sf_dir)).select("id", "prev_id")


@query("SELECT id, lag(id) OVER (PARTITION BY device_id ORDER BY started_at, id) AS prev_id FROM chunks", ("chunks",))
def join_prev_chunk_by_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("device_id").orderBy("started_at", "id")
    return fx.chunks(spark, sf_dir).select("id", F.lag("id").over(w).alias("prev_id"))


@query(f"SELECT id AS chunk_id, device_id, 'gap' AS kind, prev_ended_at AS started_at, started_at AS ended_at, round(gap_sec, 3) AS duration_sec FROM ({_FULL}) WHERE gap_event", ("chunks", "devices"))
def str_gap_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.gap_events(ingest.chunk_timing(fx.chunks(spark, sf_dir), fx.devices(spark, sf_dir)))
    return rows.withColumn("duration_sec", F.round("duration_sec", 3))


@query(f"SELECT device_id, count(*) AS late FROM ({_TIMING}) WHERE out_of_order GROUP BY 1", ("chunks",))
def str_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.chunk_timing(fx.chunks(spark, sf_dir)).filter("out_of_order").groupBy("device_id").agg(F.count("*").alias("late"))


@query("SELECT id, CASE WHEN r = 1 THEN 'accepted' WHEN sha256 = f THEN 'resent' ELSE 'conflict' END AS verdict FROM (SELECT *, row_number() OVER w AS r, first_value(sha256) OVER w AS f FROM chunks WINDOW w AS (PARTITION BY device_id, seq ORDER BY arrival, id))", ("chunks",))
def str_ingest_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.idempotent(fx.chunks(spark, sf_dir)).select("id", "verdict")


@query("SELECT device_id, seq, count(*) AS sent, count(DISTINCT sha256) AS digests FROM chunks GROUP BY 1, 2 HAVING count(*) > 1", ("chunks",))
def join_seq_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.chunks(spark, sf_dir).groupBy("device_id", "seq").agg(F.count("*").alias("sent"), F.count_distinct("sha256").alias("digests")).filter("sent > 1")


@query("SELECT device_id, max(seq) AS last_seq, max(started_at) AS last_started_at, max(ended_at) AS last_ended_at, count(*) AS chunks FROM chunks GROUP BY 1", ("chunks",))
def str_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.heartbeat(fx.chunks(spark, sf_dir))


@query("SELECT id, max(seq) OVER w AS seq_so_far, max(started_at) OVER w AS start_so_far FROM chunks WINDOW w AS (PARTITION BY device_id ORDER BY arrival, id ROWS UNBOUNDED PRECEDING)", ("chunks",))
def win_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.heartbeat_so_far(fx.chunks(spark, sf_dir)).select("id", "seq_so_far", "start_so_far")


_STALE = "SELECT device_id, name, last_seen_at, round(epoch(TIMESTAMP '2024-01-31') - epoch(last_seen_at), 3)::DOUBLE AS silence_sec FROM devices WHERE is_active AND epoch(TIMESTAMP '2024-01-31') - epoch(last_seen_at) > greatest(1.5 * coalesce(expected_chunk_sec, 60), 180)"


def _stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.stale_devices(fx.devices(spark, sf_dir), F.lit(datetime(2024, 1, 31)).cast("timestamp_ntz")).withColumn("silence_sec", F.round("silence_sec", 3))


@query(_STALE, ("devices",))
def str_stale_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stale(spark, sf_dir)


@query(f"SELECT device_id, 'stale' AS kind, silence_sec AS duration_sec FROM ({_STALE}) UNION ALL SELECT device_id, 'gap', round(gap_sec, 3) FROM ({_FULL}) WHERE gap_event", ("devices", "chunks"))
def str_gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = ingest.gap_events(ingest.chunk_timing(fx.chunks(spark, sf_dir), fx.devices(spark, sf_dir))).withColumn("duration_sec", F.round("duration_sec", 3))
    return ingest.gap_report(_stale(spark, sf_dir), events)


@query("SELECT id FROM (SELECT id, count(*) OVER (PARTITION BY device_id, kind ORDER BY epoch(started_at)::BIGINT RANGE BETWEEN 36000 PRECEDING AND 1 PRECEDING) AS n FROM (SELECT *, species AS kind FROM (SELECT id, device_id, date_trunc('second', started_at) AS started_at, seq % 2 AS species FROM chunks))) WHERE n = 0", ("chunks",))
def win_recent_gap_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.chunks(spark, sf_dir).withColumn("kind", F.col("seq") % 2)
    return ingest.suppress_repeats(rows, 36000).select("id")


@query("SELECT id FROM (SELECT id FROM (SELECT id, device_id, started_at, row_number() OVER (PARTITION BY device_id ORDER BY started_at DESC, id DESC) AS r FROM chunks) WHERE r <= 20 AND epoch(TIMESTAMP '2024-01-31') - epoch(started_at) <= 864000)", ("chunks",))
def win_debug_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.retained(fx.chunks(spark, sf_dir), F.lit(datetime(2024, 1, 31)).cast("timestamp_ntz"), 20, 864000, time="started_at").select("id")


@query("SELECT id FROM (SELECT id, sum(seq + 1) OVER (ORDER BY started_at DESC, id DESC) AS upto FROM chunks) WHERE upto <= 20000", ("chunks",))
def win_mobile_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fx.chunks(spark, sf_dir).select("id", F.col("started_at").alias("mtime"), (F.col("seq") + 1).alias("size"))
    return ingest.storage_kept(files, 20_000).select("id")


@query(f"SELECT id, CASE WHEN plat IS NOT NULL THEN round({_HAV}, 3) END AS step_m FROM (SELECT id, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM detections WHERE lat IS NOT NULL WINDOW w AS (PARTITION BY device_id ORDER BY window_start_ts, id)) x, LATERAL (SELECT plat AS lat, plon AS lon) a, LATERAL (SELECT x.lat AS lat, x.lon AS lon) b", _D)
def win_lag_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = zones.steps(fx.detections(spark, sf_dir).filter("lat is not null"))
    return rows.select("id", F.round("step_m", 3).alias("step_m"))



def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.mark_duplicates(fx.detections(spark, sf_dir))


@query()
def str_seam_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _duplicates(spark, sf_dir)


@query()
def str_seam_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detection is of the chunk of its event; only those at the seam can be duplicates."""
    zones_ = ingest.overlap_zone(ingest.chunk_timing(fx.chunks(spark, sf_dir)))
    rows = ingest.at_seam(fx.detections(spark, sf_dir).withColumn("chunk_id", F.col("id")), zones_)
    return ingest.mark_duplicates(rows, may="at_seam")


@query()
def str_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.detections(spark, sf_dir).withColumn("chunk_id", F.to_date("window_start_ts"))
    return ingest.mark_duplicates(rows, keys=("chunk_id", "device_id", "species_slug"))


@query("SELECT id, round(CASE WHEN overlap_sec <= 0 THEN 0 ELSE epoch(started_at) END, 3)::DOUBLE AS zone_start, round(CASE WHEN overlap_sec <= 0 THEN 0 ELSE epoch(started_at) + least(overlap_sec, 21600) END, 3)::DOUBLE AS zone_end FROM (" + _TIMING + ")", ("chunks",))
def fn_overlap_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = ingest.overlap_zone(ingest.chunk_timing(fx.chunks(spark, sf_dir)))
    return z.select("id", F.round("zone_start", 3).alias("zone_start"), F.round("zone_end", 3).alias("zone_end"))


@query("SELECT l_returnflag AS slug, count(*) AS n FROM lineitem WHERE l_returnflag IN (SELECT DISTINCT CASE WHEN r_regionkey = 0 THEN 'A' ELSE 'R' END FROM region) GROUP BY 1")
def join_whitelist_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = fx.table(spark, sf_dir, "region").select(F.when(F.col("r_regionkey") == 0, "A").otherwise("R").alias("slug")).distinct()
    return fx.table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "slug").join(white, "slug", "left_semi").groupBy("slug").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT lang AS slug FROM documents WHERE lang NOT IN ('en', 'de')")
def join_whitelist_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = spark.createDataFrame([("en",), ("de",)], "slug string")
    return fx.table(spark, sf_dir, "documents").select(F.col("lang").alias("slug")).distinct().join(white, "slug", "left_anti")


@query("SELECT slug, class_idx < 16 AS in_model FROM registry", ("registry",))
def join_model_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.registry(spark, sf_dir)
    return joins.in_model(r.select("slug"), r.filter("class_idx < 16")).select("slug", "in_model")


@query("SELECT p_partkey AS slug, n, CASE WHEN p_size % 5 <> 0 THEN p_size / 50.0 END AS affinity FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) LEFT JOIN part ON p_partkey = l_partkey")
def join_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonagrid.plans.aggregations import _affinity

    counts, weights = _affinity(spark, sf_dir)
    return counts.join(weights, "slug", "left").select("slug", "n", "affinity")


@query("SELECT s.id, u.name FROM submissions s LEFT JOIN users u ON u.user_id = s.user_id WHERE s.status = 'pending'", ("submissions", "users"))
def join_user_of_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.submissions(spark, sf_dir).filter("status = 'pending'").join(fx.users(spark, sf_dir).select("user_id", "name"), "user_id", "left").select("id", "name")


@query("SELECT vec_id, slug FROM embeddings JOIN registry ON class_idx = label", ("registry",))
def join_mobile_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("class_idx"))
    return e.join(fx.registry(spark, sf_dir), "class_idx").select("vec_id", "slug")


@query("SELECT DISTINCT device_id FROM detections WHERE species_slug = 'click' INTERSECT SELECT DISTINCT device_id FROM detections WHERE species_slug = 'view'", _D)
def set_intersect_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.detections(spark, sf_dir)
    return d.filter("species_slug = 'click'").select("device_id").intersect(d.filter("species_slug = 'view'").select("device_id"))


@query("SELECT y_true AS label FROM predictions UNION SELECT y_pred FROM predictions", ("predictions",))
def set_label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.predictions(spark, sf_dir)
    return p.select(F.col("y_true").alias("label")).union(p.select("y_pred")).distinct()


@query("SELECT DISTINCT lang AS slug FROM documents EXCEPT SELECT 'en'")
def set_whitelist_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select(F.col("lang").alias("slug")).subtract(spark.createDataFrame([("en",)], "slug string"))


@query("SELECT device_id, max(id) AS id, arg_max(species_slug, id) AS species_slug FROM detections GROUP BY 1", _D)
def dml_latest_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.detections(spark, sf_dir).select("device_id", "id", "species_slug")
    return states.latest(rows, "device_id", ["id"]).select("device_id", "id", "species_slug")


@query("SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.name, a.name) AS name FROM users a FULL JOIN (SELECT user_id + 10 AS user_id, CASE WHEN user_id % 2 = 0 THEN 'new' END AS name FROM users) b ON a.user_id = b.user_id", ("users",))
def dml_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = fx.users(spark, sf_dir).select("user_id", "name")
    changes = u.select((F.col("user_id") + 10).alias("user_id"), F.when(F.col("user_id") % 2 == 0, "new").alias("name"))
    return states.upsert(u, changes, "user_id")


@query("SELECT id, CASE WHEN id % 5 = 0 THEN 'fixed' ELSE species_slug END AS species_slug FROM detections", _D)
def dml_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.detections(spark, sf_dir).select("id", "species_slug")
    return states.corrected(d, d.filter("id % 5 = 0").select("id", F.lit("fixed").alias("species_slug")))


@query("SELECT id FROM detections WHERE window_start_ts >= TIMESTAMP '2024-01-15'", _D)
def dml_mobile_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.expired(fx.detections(spark, sf_dir), "2024-01-15", "window_start_ts").select("id")


_STAMP = "strftime(window_start_ts, '%Y-%m-%dT%H:%M:%S')"


@query(
    f"""SELECT d.id::VARCHAR AS id, d.device_id::VARCHAR AS device_id, 'device ' || d.device_id AS device_name, d.species_slug, coalesce(r.ru, d.species_slug) AS ru, coalesce(r.habitat, 'other') AS habitat, printf('%.4f', confidence) AS confidence,
    {_STAMP} AS start, strftime(window_end_ts, '%Y-%m-%dT%H:%M:%S') AS "end", coalesce(printf('%.6f', lat), '') AS lat, coalesce(printf('%.6f', lon), '') AS lon, '' AS duplicate_of_id FROM detections d LEFT JOIN {_SPECIES} ON r.slug = d.species_slug""",
    _D,
)
def snk_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joins.with_device_name(joins.with_species_name(fx.detections(spark, sf_dir), _species(spark, sf_dir)), fx.devices(spark, sf_dir))
    return export.csv_rows(rows)


@query(
    f"""SELECT d.id::VARCHAR AS id, d.species_slug, '"' || coalesce(r.ru, d.species_slug) || '"' AS species_ru, coalesce(r.habitat, 'other') AS habitat, printf('%.3f', confidence) AS confidence, (d.id % 4)::VARCHAR AS votes_count,
    (epoch_us(window_start_ts) // 1000)::VARCHAR AS window_start_ts, (epoch_us(window_end_ts) // 1000)::VARCHAR AS window_end_ts, CASE WHEN lat IS NULL THEN '' ELSE (d.id % 90)::VARCHAR || '.5' END AS lat, CASE WHEN lat IS NULL THEN '' ELSE (d.id % 170)::VARCHAR || '.25' END AS lon,
    '"' || {_STAMP} || '"' AS created_at_iso, CASE WHEN d.id % 5 = 0 THEN '"a ""b"", c"' ELSE '""' END AS user_corrected_species FROM detections d LEFT JOIN {_SPECIES} ON r.slug = d.species_slug""",
    _D,
)
def snk_csv_mobile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates that every engine prints alike."""
    rows = joins.with_species_name(fx.detections(spark, sf_dir), _species(spark, sf_dir))
    at = lambda n, part: F.when(F.col("lat").isNotNull(), (F.col("id") % n) + part)
    rows = rows.withColumns({"votes_count": F.col("id") % 4, "created_at": F.col("window_start_ts"), "corrected": F.when(F.col("id") % 5 == 0, 'a "b", c'), "lon": at(170, 0.25), "lat": at(90, 0.5)})
    return export.mobile_csv_rows(rows)


@query("SELECT id, CASE WHEN lat IS NULL THEN 'null' ELSE 'Point' END AS kind, round(lon, 7) AS lon, round(lat, 7) AS lat, species_slug FROM detections", _D)
def snk_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export.geojson_rows(fx.detections(spark, sf_dir))
    f = lambda path: F.get_json_object("feature", path)
    return rows.select("id", F.coalesce(f("$.geometry.type"), F.lit("null")).alias("kind"), f("$.geometry.coordinates[0]").cast("double").alias("lon"), f("$.geometry.coordinates[1]").cast("double").alias("lat"), f("$.properties.species_slug").alias("species_slug"))


@query("SELECT count(*) AS total, count(lat) AS located, count(*) - count(lat) AS unlocated FROM detections", _D)
def snk_geojson_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.geojson_counts(fx.detections(spark, sf_dir))


@query("SELECT id, user_id, status, species_slug IS NULL AS is_proposed, strftime(created_at, '%Y-%m-%d') AS created, CASE WHEN species_slug IS NULL THEN 'proposed/' || CASE WHEN coalesce(proposed_name, '') = '' THEN 'unknown' ELSE regexp_replace(proposed_name, '[^A-Za-z0-9]+', '_', 'g') END ELSE species_slug END || '/rec_' || id || '.ogg' AS path FROM submissions WHERE status = 'pending'", ("submissions",))
def snk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.manifest_rows(fx.submissions(spark, sf_dir).filter("status = 'pending'")).select("id", "user_id", "status", "is_proposed", "created", "path")


@query('SELECT "class", count(DISTINCT recording_id) AS recordings, string_agg(DISTINCT recording_id, \', \' ORDER BY recording_id) AS sources FROM recordings GROUP BY 1', ("recordings",))
def snk_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.attribution(fx.recordings(spark, sf_dir))


@query("SELECT id, CASE WHEN id IN (SELECT id FROM detections WHERE id % 3 = 0 ORDER BY window_start_ts, id LIMIT 100) THEN 1 ELSE (id % 3)::INT END AS sync_status FROM detections", _D)
def snk_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.detections(spark, sf_dir).withColumn("sync_status", (F.col("id") % 3).cast("int"))
    return export.mark_synced(d, export.sync_batch(d)).select("id", "sync_status")
