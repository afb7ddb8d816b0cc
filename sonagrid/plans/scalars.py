"""Scalar functions (inventory 2.9)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from sonagrid.functions import geo, text, time
from sonagrid.operators import ingest, voting
from sonagrid.plans.registry import query
from sonagrid.sources import files, fixtures as fx

_D = ("detections",)
_LOC = "lat IS NOT NULL"


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.detections(spark, sf_dir).filter("lat is not null")


def _celled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located detections with their cell of six characters, computed once."""
    return _located(spark, sf_dir).select("id", geo.geohash("lat", "lon", 6).alias("cell"))


@query(f"SELECT id, round(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(59.9 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(59.9)) * pow(sin(radians(41.1 - lon) / 2), 2)))), 3) AS m FROM detections WHERE {_LOC}", _D)
def fn_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir).select("id", F.round(geo.haversine("lat", "lon", 59.9, 41.1), 3).alias("m"))


@query(f"SELECT id, round(lat - degrees(500 / 6371008.8), 6) AS min_lat, round(lat + degrees(500 / 6371008.8), 6) AS max_lat, round(lon - degrees(500 / (6371008.8 * cos(radians(lat)))), 6) AS min_lon, round(lon + degrees(500 / (6371008.8 * cos(radians(lat)))), 6) AS max_lon FROM detections WHERE {_LOC}", _D)
def fn_bbox_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = geo.bbox_around("lat", "lon", 500.0)
    return _located(spark, sf_dir).select("id", *[F.round(b[k], 6).alias(k) for k in ("min_lat", "max_lat", "min_lon", "max_lon")])


def geohash_sql(precision: int, lat: str = "lat", lon: str = "lon") -> str:
    """Geohash by arithmetic: bits by division, interleaved, five to a character."""
    lon_bits, lat_bits = (5 * precision + 1) // 2, 5 * precision // 2
    x, y = f"floor(({lon} + 180) / 360 * {1 << lon_bits})::BIGINT", f"floor(({lat} + 90) / 180 * {1 << lat_bits})::BIGINT"
    chars = []
    for k in range(precision):
        parts = []
        for j, bit in enumerate(range(5 * k, 5 * k + 5)):
            source, at = (x, lon_bits - 1 - bit // 2) if bit % 2 == 0 else (y, lat_bits - 1 - bit // 2)
            parts.append(f"(({source} // {1 << at}) % 2) * {16 >> j}")
        chars.append(f"substr('{geo.BASE32}', ({' + '.join(parts)} + 1)::BIGINT, 1)")
    return " || ".join(chars)


@query(f"SELECT id, {geohash_sql(6)} AS p6, {geohash_sql(8)} AS p8 FROM detections WHERE {_LOC}", _D)
def fn_geohash_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir).select("id", geo.geohash("lat", "lon", 6).alias("p6"), geo.geohash("lat", "lon", 8).alias("p8"))


_CELL = {"min_lat": "floor((lat + 90) / 180 * 32768) * 180 / 32768 - 90", "min_lon": "floor((lon + 180) / 360 * 32768) * 360 / 32768 - 180"}


@query(f"SELECT id, round({_CELL['min_lat']}, 7) AS min_lat, round({_CELL['min_lat']} + 180 / 32768.0, 7) AS max_lat, round({_CELL['min_lon']}, 7) AS min_lon, round({_CELL['min_lon']} + 360 / 32768.0, 7) AS max_lon FROM detections WHERE {_LOC}", _D)
def fn_geohash_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = geo.geohash_box("cell", 6)
    return _celled(spark, sf_dir).select("id", *[F.round(b[k], 7).alias(k) for k in ("min_lat", "max_lat", "min_lon", "max_lon")])


@query(f"SELECT id, round({_CELL['min_lat']} + 90 / 32768.0, 7) AS lat, round({_CELL['min_lon']} + 180 / 32768.0, 7) AS lon FROM detections WHERE {_LOC}", _D)
def fn_geohash_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = geo.geohash_center("cell", 6)
    return _celled(spark, sf_dir).select("id", F.round(c["lat"], 7).alias("lat"), F.round(c["lon"], 7).alias("lon"))


@query(f"SELECT id, 5 AS corners, TRUE AS closed FROM detections WHERE {_LOC}", _D)
def fn_geohash_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = geo.cell_polygon("cell", 6)
    return _celled(spark, sf_dir).select("id", F.size(p).alias("corners"), (p[0] == p[4]).alias("closed"))


@query("SELECT device_id, round(180 / 32768.0 * 111320, 4) AS height_m, round(360 / 32768.0 * 111320 * cos(radians(lat)), 4) AS width_m FROM devices", ("devices",))
def fn_cell_size_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    height, width = geo.cell_size_m(6, F.col("lat"))
    return fx.devices(spark, sf_dir).select("device_id", F.round(height, 4).alias("height_m"), F.round(width, 4).alias("width_m"))


@query("SELECT device_id, (floor((lat + 0.01 + 90) / 180 * 32768) - floor((lat + 90) / 180 * 32768) + 1)::BIGINT * (floor((lon + 0.02 + 180) / 360 * 32768) - floor((lon + 180) / 360 * 32768) + 1)::BIGINT AS cells FROM devices", ("devices",))
def fn_cells_in_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = geo.cells_in_box("lat", F.col("lat") + 0.01, "lon", F.col("lon") + 0.02, 6)
    return fx.devices(spark, sf_dir).select("device_id", F.size(cells).cast("bigint").alias("cells"))


@query(f"SELECT left(cell, 3) AS area, count(*) AS cells FROM (SELECT DISTINCT {geohash_sql(6)} AS cell FROM detections WHERE {_LOC}) GROUP BY 1", _D)
def fn_merge_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _located(spark, sf_dir).select(geo.geohash("lat", "lon", 6).alias("cell")).distinct()
    return cells.groupBy(F.left("cell", F.lit(3)).alias("area")).agg(F.count("*").alias("cells"))


@query("SELECT device_id, 49 AS points, TRUE AS closed, round(lon + 500 / (111320 * cos(radians(lat))), 5) AS east FROM devices", ("devices",))
def fn_circle_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = geo.circle_ring("lat", "lon", 500.0)
    return fx.devices(spark, sf_dir).select("device_id", F.size(ring).alias("points"), (ring[0] == ring[48]).alias("closed"), F.round(ring[0][0], 5).alias("east"))


@query("SELECT id, coalesce(lat * 2 BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, FALSE) AS ok FROM detections", _D)
def fn_validate_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.detections(spark, sf_dir).select("id", F.coalesce(geo.valid_coordinates(F.col("lat") * 2, "lon"), F.lit(False)).alias("ok"))


@query("SELECT * FROM (VALUES ('1,2,3,4', 1.0::DOUBLE, 4.0::DOUBLE, '1.000000,2.000000,3.000000,4.000000'), ('3,2,1,4', NULL, NULL, NULL), ('a,b', NULL, NULL, NULL)) t(text, min_lon, max_lat, back)")
def fn_parse_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = geo.parse_bbox("text")
    rows = spark.createDataFrame([("1,2,3,4",), ("3,2,1,4",), ("a,b",)], "text string")
    back = F.when(b.isNotNull(), geo.format_bbox(b["min_lon"], b["min_lat"], b["max_lon"], b["max_lat"]))
    return rows.select("text", b["min_lon"].alias("min_lon"), b["max_lat"].alias("max_lat"), back.alias("back"))


@query("SELECT id, CAST(hour(window_start_ts) AS INT) AS hour, strftime(window_start_ts, '%Y-%m-%d') AS day, strftime(window_start_ts, '%Y-%m') AS month FROM detections", _D)
def fn_day_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = "window_start_ts"
    return fx.detections(spark, sf_dir).select("id", F.hour(ts).alias("hour"), F.date_format(ts, "yyyy-MM-dd").alias("day"), F.date_format(ts, "yyyy-MM").alias("month"))


@query("SELECT id, date_trunc('hour', window_start_ts) - to_hours((hour(window_start_ts) % 5)::INT) AS b5, date_trunc('day', window_start_ts)::TIMESTAMP AS b24 FROM detections", _D)
def fn_time_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("window_start_ts")
    return fx.detections(spark, sf_dir).select("id", time.time_bucket(ts, 5).cast("timestamp_ntz").alias("b5"), time.time_bucket(ts, 24).cast("timestamp_ntz").alias("b24"))


@query("SELECT * FROM (VALUES ('1704067200', 1704067200000000), ('1704067200.5', 1704067200500000), ('2024-01-01T00:00:00Z', 1704067200000000), ('nonsense', NULL)) t(text, us)")
def fn_parse_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("1704067200",), ("1704067200.5",), ("2024-01-01T00:00:00Z",), ("nonsense",)], "text string")
    return rows.select("text", F.unix_micros(time.parse_timestamp("text")).alias("us"))


@query("SELECT device_id, round(epoch(TIMESTAMP '2024-01-31') - epoch(last_seen_at), 3)::DOUBLE AS silence_sec, CASE WHEN epoch(TIMESTAMP '2024-01-31') - epoch(last_seen_at) <= 43200 THEN 'online' WHEN epoch(TIMESTAMP '2024-01-31') - epoch(last_seen_at) <= 129600 THEN 'silent' ELSE 'offline' END AS state FROM devices", ("devices",))
def fn_device_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit(datetime(2024, 1, 31)).cast("timestamp_ntz")
    return fx.devices(spark, sf_dir).select("device_id", F.round(time.between_sec(as_of, "last_seen_at"), 3).alias("silence_sec"), time.device_state("last_seen_at", as_of, F.lit(43200.0)).alias("state"))


@query("SELECT id, date_trunc('day', window_start_ts) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS day_end, round(epoch(window_start_ts), 3)::DOUBLE AS sec FROM detections", _D)
def fn_day_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("window_start_ts")
    return fx.detections(spark, sf_dir).select("id", time.day_end(ts).cast("timestamp_ntz").alias("day_end"), F.round(time.seconds(ts), 3).alias("sec"))


@query("SELECT id, (id * 7 % 400)::DOUBLE AS gap, (id * 7 % 400) > greatest(1.5 * (id % 3 * 60), 180) AS required FROM detections", _D)
def fn_gap_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = (F.col("id") * 7 % 400).cast("double")
    return fx.detections(spark, sf_dir).select("id", gap.alias("gap"), ingest.gap_required(gap, F.col("id") % 3 * 60).alias("required"))


@query("SELECT vec_id, round(len, 6)::DOUBLE AS len, round(CASE WHEN short > 0 THEN len / short ELSE 1 END, 6)::DOUBLE AS frac FROM (SELECT vec_id, greatest(0, least(10, vec_id % 17) - greatest(3, vec_id % 5)) AS len, least(7, vec_id % 17 - vec_id % 5) AS short FROM embeddings WHERE vec_id % 17 > vec_id % 5)")
def fn_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "embeddings").filter("vec_id % 17 > vec_id % 5")
    spans = F.lit(3), F.lit(10), F.col("vec_id") % 5, F.col("vec_id") % 17
    return e.select("vec_id", F.round(time.overlap_length(*spans).cast("double"), 6).alias("len"), F.round(time.overlap_share(*spans), 6).alias("frac"))


@query("SELECT * FROM (VALUES ('/d/anas/rec_12_part03.wav', 'rec_12'), ('XC77-clip9.WAV', 'XC77'), ('a_chunk4_x.wav', 'a'), ('plain.wav', 'plain'), ('PART_Part1.wav', 'PART')) t(path, recording)")
def fn_recording_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("/d/anas/rec_12_part03.wav",), ("XC77-clip9.WAV",), ("a_chunk4_x.wav",), ("plain.wav",), ("PART_Part1.wav",)], "path string")
    return rows.select("path", text.recording_id("path").alias("recording"))


@query("SELECT n_name, regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g') AS safe, upper(left(n_name, 1)) || lower(substr(replace(n_name, '_', ' '), 2)) AS sci FROM nation")
def fn_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "nation").select("n_name", text.sanitize(F.lower("n_name")).alias("safe"), text.scientific_name("n_name").alias("sci"))


@query("SELECT slug, ru || ' (' || slug || ')' AS label FROM registry", ("registry",))
def fn_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.registry(spark, sf_dir).select("slug", text.species_label(F.col("ru"), F.col("slug")).alias("label"))


@query("SELECT * FROM (VALUES (' a, b,,c ', 'a|b|c', '\" a, b,,c \"'), ('x', 'x', 'x')) t(text, parts, quoted)")
def fn_split_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(" a, b,,c ",), ("x",)], "text string")
    return rows.select("text", F.array_join(text.split_csv("text"), "|").alias("parts"), text.csv_quoted("text").alias("quoted"))


@query("SELECT device_id, name || ' is silent since ' || strftime(last_seen_at, '%H:%M') || ' (' || floor(device_id * 90 / 60)::BIGINT || ' min)' AS msg FROM devices", ("devices",))
def fn_format_msg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.devices(spark, sf_dir).select("device_id", text.alert_text(F.col("name"), F.col("last_seen_at"), F.col("device_id") * 90).alias("msg"))


@query("SELECT event_id, sha256(props) AS digest, left(sha256(props), 12) AS prefix FROM events")
def fn_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2("props", 256)
    return fx.table(spark, sf_dir, "events").select("event_id", digest.alias("digest"), text.token_prefix(digest).alias("prefix"))


_EXP = "list_transform(embedding[1:10], lambda v: exp(v::DOUBLE))"


@query(f"SELECT vec_id, round({_EXP}[1] / list_sum({_EXP}), 6) AS p0, round({_EXP}[10] / list_sum({_EXP}), 6) AS p9 FROM embeddings")
def fn_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = voting.softmax(F.transform(F.slice("embedding", 1, 10), lambda v: v.cast("double")))
    return fx.table(spark, sf_dir, "embeddings").withColumn("p", p).select("vec_id", F.round(F.col("p")[0], 6).alias("p0"), F.round(F.col("p")[9], 6).alias("p9"))


@query("SELECT vec_id, round((embedding[1]::DOUBLE + embedding[11]::DOUBLE + embedding[21]::DOUBLE) / 3, 6) AS m0 FROM embeddings")
def fn_mean_tta(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = lambda k: F.transform(F.slice("embedding", k, 10), lambda v: v.cast("double"))
    rows = fx.table(spark, sf_dir, "embeddings").select("vec_id", view(1).alias("a"), view(11).alias("b"), view(21).alias("c"))
    return rows.select("vec_id", F.round(voting.mean_views(F.col("a"), F.col("b"), F.col("c"))[0], 6).alias("m0"))


@query("SELECT vec_id, class_idx, rnk FROM (SELECT vec_id, CAST(i - 1 AS INT) AS class_idx, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY embedding[i] DESC, i) - 1 AS INT) AS rnk FROM embeddings, range(1, 11) r(i)) WHERE rnk < 3")
def topk_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = voting.top_classes(F.slice("embedding", 1, 10), 3)
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(top).alias("rnk", "x")).select("vec_id", "x.class_idx", "rnk")


@query("SELECT vec_id, CAST(list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS INT) AS best FROM embeddings")
def fn_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.array(*[F.lit(k) for k in range(10)])
    m = F.map_from_arrays(order, F.slice("embedding", 1, 10))
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", text.argmax(m, order).alias("best"))


@query("SELECT vec_id, round(embedding[28]::DOUBLE, 6) AS first_cropped, round(embedding[60]::DOUBLE, 6) AS rolled_first FROM embeddings")
def fn_crop_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda v: v.cast("double"))
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", F.round(files.crop_or_pad(e, 10)[0], 6).alias("first_cropped"), F.round(files.rolled(e, 5)[0], 6).alias("rolled_first"))


def _starts_sql(stride: float, least: float) -> str:
    last = f"floor((dur - 5) / {stride})"
    return f"""array_to_string(list_transform(list_transform(range(0, (greatest({last}, 0) + 1)::BIGINT), lambda i: i * {stride}::DOUBLE)
      || CASE WHEN dur > 5 AND dur - 5 - {last} * {stride} > 0 AND dur - {last} * {stride} > {least} THEN [dur - 5] ELSE [] END, lambda x: printf('%.2f', x)), ',')"""


@query(f"SELECT vec_id, {_starts_sql(2.5, 0)} AS starts, {_starts_sql(12, 6)} AS wide FROM (SELECT vec_id, (vec_id % 203) * 0.25::DOUBLE AS dur FROM embeddings)")
def fn_window_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By both rules for the last window; they differ where the stride is over two windows."""
    rows = fx.table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 203 * 0.25).alias("dur"))
    text = lambda starts: F.array_join(F.transform(starts, lambda x: F.format_string("%.2f", x.cast("double"))), ",")
    return rows.select("vec_id", text(voting.window_starts(F.col("dur"))).alias("starts"), text(voting.window_starts(F.col("dur"), stride=12.0, least_rest=6.0)).alias("wide"))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INT) AS k FROM events")
def fn_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k int")["k"]
    return fx.table(spark, sf_dir, "events").select("event_id", parsed.alias("k"))


@query("SELECT * FROM (VALUES ('RIFF____WAVE', 'wav'), ('fLaC', 'flac'), ('OggS', 'ogg'), ('ID3x', 'mp3'), ('____ftyp', 'm4a'), ('zzzz', 'unknown')) t(head, format)")
def src_audio_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("RIFF____WAVE",), ("fLaC",), ("OggS",), ("ID3x",), ("____ftyp",), ("zzzz",)], "head string")
    return rows.select("head", files.sniff_format(F.col("head").cast("binary")).alias("format"))
