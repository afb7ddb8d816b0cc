"""Spatial analytics (inventory 2.12)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from sonagrid.operators import contours, zones
from sonagrid.operators.filters import ObservationFilter
from sonagrid.plans.registry import query
from sonagrid.plans.scalars import geohash_sql
from sonagrid.sources import fixtures as fx

_D = ("detections",)
_CELLS = f"(SELECT *, {geohash_sql(6)} AS cell FROM detections WHERE lat IS NOT NULL)"
_GRID = f"SELECT cell, count(*) AS cnt, sum(confidence) AS weight, avg(confidence) AS mean_confidence, count(DISTINCT device_id) AS devices, min(window_start_ts) AS first_seen, max(window_start_ts) AS last_seen FROM {_CELLS} GROUP BY cell"


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.detections(spark, sf_dir).filter("lat is not null")


@query(f"SELECT cell, cnt, round(weight, 4) AS weight, round(mean_confidence, 4) AS mean_confidence, devices, first_seen, last_seen, round(weight / max(weight) OVER (), 4) AS heat FROM ({_GRID})", _D)
def geo_grid_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = zones.grid(_located(spark, sf_dir))
    return g.select("cell", "cnt", F.round("weight", 4).alias("weight"), F.round("mean_confidence", 4).alias("mean_confidence"), "devices", "first_seen", "last_seen", "heat")


@query(f"SELECT cell, round(cnt / max(cnt) OVER (), 4) AS heat FROM ({_GRID})", _D)
def agg_grid_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.grid(_located(spark, sf_dir), weighted=False).select("cell", "heat")


@query(f"SELECT cell, cnt FROM ({_GRID}) ORDER BY cnt DESC, cell LIMIT 20", _D)
def topk_grid_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.grid(_located(spark, sf_dir)).orderBy(F.desc("cnt"), "cell").limit(20).select("cell", "cnt")


_COVERED = f"""SELECT c.cell, coalesce(bool_or(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(nlat - v.lat) / 2), 2) + cos(radians(v.lat)) * cos(radians(nlat)) * pow(sin(radians(clon + greatest(-180 / 32768.0, least(180 / 32768.0, (v.lon - clon) / cos(radians(nlat)))) - v.lon) / 2), 2)))) <= 50.0), FALSE) AS covered
  FROM (SELECT DISTINCT cell, floor((lat + 90) / 180 * 32768) * 180 / 32768 - 90 + 90 / 32768.0 AS clat, floor((lon + 180) / 360 * 32768) * 360 / 32768 - 180 + 180 / 32768.0 AS clon FROM {_CELLS}) c
  CROSS JOIN (SELECT DISTINCT lat, lon FROM devices WHERE is_active) v, LATERAL (SELECT least(greatest(v.lat, clat - 90 / 32768.0), clat + 90 / 32768.0) AS nlat) GROUP BY 1"""


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = zones.grid(_located(spark, sf_dir)).select("cell")
    return zones.covered_cells(cells, fx.devices(spark, sf_dir), 50.0)


@query(_COVERED, ("detections", "devices"))
def geo_cell_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered(spark, sf_dir)


@query(f"SELECT count(*) FILTER (WHERE NOT covered) AS outside, count(*) AS cells FROM ({_COVERED})", ("detections", "devices"))
def agg_cells_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered(spark, sf_dir).agg(F.count_if(~F.col("covered")).alias("outside"), F.count("*").alias("cells"))


_COVERAGE = f"""SELECT device_id, count(DISTINCT cell) AS cells FROM (SELECT device_id, {geohash_sql(6, "plat", "plon")} AS cell, 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(plat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * pow(sin(radians(plon - lon) / 2), 2)))) AS d
  FROM (SELECT v.*, (floor((lat + 90) / 180 * 32768) + i + 0.5) * 180 / 32768 - 90 AS plat, (floor((lon + 180) / 360 * 32768) + j + 0.5) * 360 / 32768 - 180 AS plon FROM devices v, range(-1, 2) a(i), range(-1, 2) b(j) WHERE is_active)) WHERE d <= 750 GROUP BY 1"""


@query(_COVERAGE, ("devices",))
def geo_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.coverage(fx.devices(spark, sf_dir), 500.0).select("device_id", "cells")


@query()
def geo_covered_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.covered_cell_set(fx.devices(spark, sf_dir), 500.0)


_P8 = geohash_sql(8)
_DIFF = f"""(SELECT cell, coalesce(a, 0) AS count_a, coalesce(b, 0) AS count_b, round((coalesce(b, 0) - coalesce(a, 0)) / n, 4) AS delta,
  CASE WHEN coalesce(a, 0) = 0 THEN 'appeared' WHEN coalesce(b, 0) = 0 THEN 'disappeared' WHEN b - a >= 1 THEN 'grew' WHEN b - a <= -1 THEN 'shrunk' ELSE 'stable' END AS change FROM
  (SELECT cell, count(*) AS a FROM (SELECT {_P8} AS cell FROM detections WHERE lat IS NOT NULL AND species_slug = 'click' AND window_start_ts <= TIMESTAMP '2024-01-15 23:59:59') GROUP BY 1) x
  FULL JOIN (SELECT cell, count(*) AS b FROM (SELECT {_P8} AS cell FROM detections WHERE lat IS NOT NULL AND species_slug = 'click' AND window_start_ts >= TIMESTAMP '2024-01-16') GROUP BY 1) y USING (cell), (SELECT 1.0 AS n))"""


def _diff(spark: SparkSession, sf_dir: str, normalize: bool = False) -> DataFrame:
    d = fx.detections(spark, sf_dir)
    a = ObservationFilter(species=["click"], end=datetime(2024, 1, 15, 23, 59, 59)).apply(d)
    b = ObservationFilter(species=["click"], start=datetime(2024, 1, 16)).apply(d)
    n = fx.devices(spark, sf_dir).filter("is_active").agg(F.count("*").alias("n"))
    return zones.period_diff(a, b, n, precision=8, normalize=normalize)


@query(f"SELECT cell, count_a, count_b, delta::DOUBLE AS delta, change FROM {_DIFF}", _D)
def join_period_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).select("cell", "count_a", "count_b", "delta", "change")


@query(f"SELECT cell, count_a, count_b, delta::DOUBLE AS delta, change FROM {_DIFF} WHERE change <> 'stable'", _D)
def geo_period_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.changed(_diff(spark, sf_dir)).select("cell", "count_a", "count_b", "delta", "change")


@query(f"SELECT cell, round((count_b - count_a) / (SELECT count(*) FROM devices WHERE is_active), 4)::DOUBLE AS delta FROM {_DIFF}", ("detections", "devices"))
def geo_period_diff_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir, normalize=True).select("cell", "delta")


@query(f"SELECT c.change, count(d.cell) AS cnt FROM (VALUES ('appeared'), ('disappeared'), ('grew'), ('shrunk'), ('stable')) c(change) LEFT JOIN {_DIFF} d ON d.change = c.change GROUP BY 1", _D)
def agg_period_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonagrid.operators.aggregates import count_by

    return count_by(_diff(spark, sf_dir), "change", ["appeared", "disappeared", "grew", "shrunk", "stable"])


_FIRST = "(SELECT *, lag(lat) OVER (ORDER BY window_start_ts, id) AS plat, lag(lon) OVER (ORDER BY window_start_ts, id) AS plon FROM (SELECT * FROM detections WHERE lat IS NOT NULL ORDER BY window_start_ts, id LIMIT 200))"


@query(f"SELECT round(least(greatest(list_sort(list(m))[len(list(m)) // 2 + 1] / 2, 150), 2000), 4) AS bandwidth FROM (SELECT 2 * 6371008.8 * asin(sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2))) AS m FROM {_FIRST} WHERE plat IS NOT NULL)", _D)
def geo_auto_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.auto_bandwidth(_located(spark, sf_dir)).select(F.round("bandwidth", 4).alias("bandwidth"))


@query("SELECT round(greatest((max(lon) - min(lon)) * 111320 * cos(radians(avg(lat))), (max(lat) - min(lat)) * 111320), 3) AS spread FROM detections WHERE lat IS NOT NULL", _D)
def geo_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.spread(_located(spark, sf_dir)).select(F.round("spread", 3).alias("spread"))


_KDE = """WITH o AS (SELECT avg(lat) AS lat0, avg(lon) AS lon0, sum(confidence) AS t FROM detections WHERE lat IS NOT NULL),
  p AS (SELECT (lon - lon0) * 111320 * cos(radians(lat0)) AS x, (lat - lat0) * 111320 AS y, confidence / t AS w FROM detections, o WHERE lat IS NOT NULL),
  m AS (SELECT sum(w * x) AS mx, sum(w * y) AS my, sum(w * w) AS w2, sum(w * x * x) AS xx, sum(w * y * y) AS yy, sum(w * x * y) AS xy, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
  c AS (SELECT *, (xx - mx * mx) * f AS cxx, (yy - my * my) * f AS cyy, (xy - mx * my) * f AS cxy FROM (SELECT *, pow(500 / greatest(x1 - x0, y1 - y0), 2) / (1 - w2) AS f FROM m)),
  g AS (SELECT c.*, cxx * cyy - cxy * cxy AS det, i::INT AS gx, j::INT AS gy, x0 - 500 + i * (x1 - x0 + 1000) / 63 AS px, y0 - 500 + j * (y1 - y0 + 1000) / 63 AS py FROM c, range(64) a(i), range(64) b(j))
  SELECT gx, gy, round(1e9 * sum(w * exp(-0.5 * (cyy * (px - x) * (px - x) - 2 * cxy * (px - x) * (py - y) + cxx * (py - y) * (py - y)) / det) / (2 * pi() * sqrt(det))), 3) AS density FROM g, p GROUP BY 1, 2"""


@query(_KDE.replace("WITH o AS", "SELECT * FROM (WITH o AS", 1) + ")", _D)
def geo_kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = zones.kde(_located(spark, sf_dir), 500.0, fold_m=0)
    return k.select("gx", "gy", F.round(F.col("density") * 1e9, 3).alias("density"))


@query()
def geo_contour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed contours of the density, and the boundary of its densest zone."""
    rings = contours.rings(zones.kde(_located(spark, sf_dir), 500.0, size=32))
    shown = F.array_join(F.transform("points", lambda p: F.format_string("%.3f %.3f", p["x"], p["y"])), ", ")
    return rings.select("share", "layer", (F.size("points") - 1).alias("corners"), F.round("area", 1).alias("area"), F.concat(F.lit("POLYGON (("), shown, F.lit("))")).alias("polygon"))


@query()
def geo_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.hotspots(_located(spark, sf_dir), eps_m=300.0)


@query()
def geo_hotspots_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.hotspots(_located(spark, sf_dir), eps_m=300.0, standard=False)


@query("SELECT DISTINCT cell FROM " + _CELLS, _D)
def set_distinct_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.grid(_located(spark, sf_dir)).select("cell")


@query("SELECT id, 'Feature' AS type, 'Point' AS kind FROM detections WHERE lat IS NOT NULL", _D)
def geo_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    rows = zones.features(_located(spark, sf_dir), point, "id")
    f = lambda path: F.get_json_object("feature", path)
    return rows.select(f("$.properties.id").cast("bigint").alias("id"), f("$.type").alias("type"), f("$.geometry.type").alias("kind"))


@query("SELECT round(180 / 32768.0 * 111320, 4) AS cell_m, 180 / 32768.0 * 111320 > 2 * 300 AS too_coarse")
def geo_granularity_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonagrid.functions.geo import DEGREE_M, cell_size_deg

    height = cell_size_deg(6)[0] * DEGREE_M
    return spark.range(1).select(F.round(F.lit(height), 4).alias("cell_m"), F.lit(height > 2 * 300).alias("too_coarse"))
