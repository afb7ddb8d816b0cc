"""Grouped summaries (inventory 2.5)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from sonagrid.functions import time
from sonagrid.operators import aggregates as agg, dataset, ingest
from sonagrid.plans.registry import query
from sonagrid.sources import fixtures as fx

_D = ("detections",)


@query("SELECT species_slug, count(*) AS cnt, max(window_start_ts) AS last_seen, round(avg(confidence), 4) AS avg_confidence FROM detections GROUP BY 1", _D)
def agg_species_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.species_summary(fx.detections(spark, sf_dir))


@query("SELECT species_slug, count(*) AS cnt FROM (SELECT * FROM detections ORDER BY window_start_ts, id LIMIT 200) GROUP BY 1", _D)
def agg_species_summary_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonagrid.operators.filters import ObservationFilter

    rows = ObservationFilter(require_location=False, limit=200).apply(fx.detections(spark, sf_dir))
    return agg.species_summary(rows).select("species_slug", "cnt")


_HOURLY = "SELECT s.species_slug, CAST(h AS INT) AS hour, count(d.id) AS cnt FROM (SELECT DISTINCT species_slug FROM detections) s CROSS JOIN range(24) r(h) LEFT JOIN detections d ON d.species_slug = s.species_slug AND hour(d.window_start_ts) = h GROUP BY 1, 2"


@query(_HOURLY, _D)
def agg_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.hourly(fx.detections(spark, sf_dir))


@query(f"SELECT species_slug, string_agg(cnt, ',' ORDER BY hour) AS hours FROM ({_HOURLY}) GROUP BY 1", _D)
def agg_hourly_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.hourly_vector(fx.detections(spark, sf_dir)).select("species_slug", F.array_join(F.transform("hours", lambda x: x.cast("string")), ",").alias("hours"))


@query("SELECT species_slug, CAST(hour AS INT) AS peak_hour, cnt FROM (SELECT species_slug, hour(window_start_ts) AS hour, count(*) AS cnt, row_number() OVER (PARTITION BY species_slug ORDER BY count(*) DESC, hour(window_start_ts)) AS r FROM detections GROUP BY 1, 2) WHERE r = 1", _D)
def agg_peak_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.peak_hour(fx.detections(spark, sf_dir))


@query("SELECT count(*) AS n FROM detections WHERE lat IS NOT NULL", _D)
def agg_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.detections(spark, sf_dir).filter("lat is not null").agg(F.count("*").alias("n"))


@query("SELECT CAST(hour(window_start_ts) AS INT) AS hour, count(*) AS cnt, round(count(*) / max(count(*)) OVER (), 4) AS scaled FROM detections GROUP BY 1", _D)
def agg_hour_totals_ui(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.hour_totals(fx.detections(spark, sf_dir))


@query("SELECT device_id, count(*) AS cnt FROM detections GROUP BY 1", _D)
def agg_device_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.device_detections(fx.detections(spark, sf_dir))


@query("SELECT species_slug, count(*) AS cnt FROM detections WHERE lat IS NOT NULL GROUP BY 1", _D)
def agg_species_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.count_by(fx.detections(spark, sf_dir).filter("lat is not null"), "species_slug")


@query(
    """SELECT (SELECT count(*) FROM detections) AS detections, (SELECT count(*) FROM detections WHERE lat IS NOT NULL) AS located, (SELECT count(DISTINCT species_slug) FROM detections) AS species,
    (SELECT count(*) FROM devices) AS devices, (SELECT count(*) FROM devices WHERE is_active) AS active, (SELECT count(*) FROM devices WHERE is_active AND epoch(TIMESTAMP '2024-01-31') - epoch(last_seen_at) > 259200) AS stale,
    (SELECT count(*) FROM chunks WHERE device_id % 2 = 0 AND started_at >= TIMESTAMP '2024-01-30') AS gaps_24h""",
    ("detections", "devices", "chunks"),
)
def agg_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.chunks(spark, sf_dir).select(F.when(F.col("device_id") % 2 == 0, "gap").otherwise("error").alias("kind"), F.col("started_at").alias("created_at"))
    as_of = F.lit(datetime(2024, 1, 31)).cast("timestamp_ntz")
    return agg.dashboard(fx.detections(spark, sf_dir), fx.devices(spark, sf_dir), events, as_of)


@query("SELECT (SELECT count(*) FROM submissions WHERE status = 'pending') AS queued, (SELECT count(*) FROM submissions WHERE status = 'rejected') AS failed, (SELECT count(*) FROM detections) AS detections, (SELECT count(*) FROM devices) AS devices", ("submissions", "detections", "devices"))
def agg_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.status_counts(fx.submissions(spark, sf_dir), fx.detections(spark, sf_dir), fx.devices(spark, sf_dir))


@query("SELECT count(*) AS species, count(*) FILTER (WHERE class_idx < 16) AS in_model, count(*) FILTER (WHERE class_idx % 2 = 0) AS observed FROM registry", ("registry",))
def agg_catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.registry(spark, sf_dir)
    return agg.catalog_counts(r, r.filter("class_idx < 16"), r.filter("class_idx % 2 = 0"))


@query("SELECT habitat, string_agg(slug, ',' ORDER BY ru, slug) AS species FROM registry GROUP BY 1", ("registry",))
def agg_group_by_habitat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.group_by_habitat(fx.registry(spark, sf_dir)).select("habitat", F.array_join(F.transform("species", lambda x: x["slug"]), ",").alias("species"))


def _affinity(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = fx.table(spark, sf_dir, "part")
    weights = part.select(F.col("p_partkey").alias("slug"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") / 50.0).alias("affinity"))
    counts = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("slug")).agg(F.count("*").alias("n"))
    return counts, weights


@query(
    """WITH c AS (SELECT l_partkey AS slug, count(*) AS n FROM lineitem GROUP BY 1), w AS (SELECT p_partkey AS slug, CASE WHEN p_size % 5 <> 0 THEN p_size / 50.0 END AS affinity FROM part)
    SELECT 'ok' AS status, round(sum(affinity * n) / sum(n) FILTER (WHERE affinity IS NOT NULL), 4) AS wetland_index, count(*) FILTER (WHERE affinity IS NULL) = 0 AS calibrated, count(*) FILTER (WHERE affinity IS NULL) AS uncalibrated, sum(n)::BIGINT AS total FROM c LEFT JOIN w USING (slug)"""
)
def agg_wetland_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.wetland_index(*_affinity(spark, sf_dir))


@query("SELECT c_custkey AS id, round((c_acctbal + c_acctbal / 2 + c_acctbal / 4) / 3, 4) AS temp_avg, round(least(c_acctbal, c_acctbal / 4), 4) AS temp_min, round(greatest(c_acctbal, c_acctbal / 4), 4) AS temp_max, CASE WHEN c_custkey % 2 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS precip_total FROM customer")
def agg_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("c_acctbal")
    rows = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array(b, b / 2, b / 4).alias("temperature_2m"), F.array(F.when(F.col("c_custkey") % 2 == 0, F.lit(0.5)), F.lit(None).cast("double")).alias("precipitation"), F.array(b).alias("relative_humidity_2m"), F.array(b).alias("wind_speed_10m"))
    return agg.weather_summary(rows).select("id", *[F.round(c, 4).alias(c) for c in ("temp_avg", "temp_min", "temp_max")], "precip_total")


@query("SELECT coalesce(species_slug, 'unknown') AS sp, count(*) AS cnt FROM submissions WHERE status IN ('pending', 'accepted') GROUP BY 1", ("submissions",))
def agg_species_counts_bot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.submission_species(fx.submissions(spark, sf_dir).filter(F.col("status").isin("pending", "accepted")))


@query("SELECT proposed_name, count(*) AS cnt FROM submissions WHERE proposed_name <> '' GROUP BY 1", ("submissions",))
def agg_proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.proposed_names(fx.submissions(spark, sf_dir))


@query("SELECT count(*) AS n FROM submissions WHERE status = 'pending'", ("submissions",))
def agg_pending_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.submissions(spark, sf_dir).filter("status = 'pending'").agg(F.count("*").alias("n"))


_TRUST = """SELECT u.user_id, coalesce(accepted, 0) AS accepted, coalesce(rejected, 0) AS rejected, coalesce(total, 0) AS total, CASE WHEN coalesce(accepted + rejected, 0) = 0 THEN 1.0 ELSE round(accepted / (accepted + rejected), 2) END::DOUBLE AS trust
  FROM users u LEFT JOIN (SELECT user_id, count(*) FILTER (WHERE status = 'accepted') AS accepted, count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) AS total FROM submissions GROUP BY 1) s ON u.user_id = s.user_id"""


@query(_TRUST, ("users", "submissions"))
def agg_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.trust(fx.users(spark, sf_dir), fx.submissions(spark, sf_dir))


@query(f"SELECT a.user_id, coalesce(t.trust, 0.0)::DOUBLE AS trust FROM (VALUES (1), (2), (-5)) a(user_id) LEFT JOIN ({_TRUST}) t ON a.user_id = t.user_id", ("users", "submissions"))
def agg_trust_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(1,), (2,), (-5,)], "user_id int")
    return agg.trust_of(asked, fx.users(spark, sf_dir), fx.submissions(spark, sf_dir))


@query("SELECT species_slug, max(upper(species_slug)) AS species_ru, count(*) AS cnt FROM detections GROUP BY 1 ORDER BY cnt DESC, 1 LIMIT 10", _D)
def agg_top_species_mobile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.mobile_top_species(fx.detections(spark, sf_dir).withColumn("species_ru", F.upper("species_slug")))


@query("SELECT CAST((epoch_ms(window_start_ts) // 3600000) % 24 AS INT) AS hour, count(*) AS cnt FROM detections GROUP BY 1", _D)
def agg_hourly_mobile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.mobile_hourly(fx.detections(spark, sf_dir).withColumn("timestamp_ms", time.epoch_ms("window_start_ts")))


@query("SELECT count(*) AS total, count(DISTINCT species_slug) AS species FROM detections", _D)
def agg_mobile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.mobile_summary(fx.detections(spark, sf_dir))


@query("SELECT CASE WHEN device_id % 3 = 0 THEN 'unknown' ELSE 'h' || device_id % 3 END AS habitat, count(*) AS cnt FROM detections GROUP BY 1", _D)
def agg_mobile_habitats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.detections(spark, sf_dir).withColumn("habitat", F.when(F.col("device_id") % 3 == 0, " ").otherwise(F.concat(F.lit("h"), (F.col("device_id") % 3).cast("string"))))
    return agg.habitat_distribution(rows)


@query("SELECT state, count(*) AS cnt FROM (SELECT CASE WHEN s <= i THEN 'online' WHEN s <= 3 * i THEN 'silent' ELSE 'offline' END AS state FROM (SELECT epoch(TIMESTAMP '2024-01-31') - epoch(last_seen_at) AS s, coalesce(expected_chunk_sec, 60) * 720 AS i FROM devices)) GROUP BY 1", ("devices",))
def agg_device_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.devices(spark, sf_dir).withColumn("expected_chunk_sec", F.coalesce("expected_chunk_sec", F.lit(60.0)) * 720)
    return agg.count_by(ingest.device_states(d, F.lit(datetime(2024, 1, 31)).cast("timestamp_ntz")), "state")


@query('SELECT lang AS "class", count(*) AS n, 1.0::DOUBLE / count(*) AS weight FROM documents GROUP BY 1 UNION ALL SELECT \'xx\', 0, 1.0')
def agg_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.recordings(spark, sf_dir)
    return dataset.class_counts(r, r.select("class").union(spark.createDataFrame([("xx",)], "class string")))


@query("SELECT t.l AS y_true, p.l AS y_pred, count(r.doc_id) AS n FROM (SELECT y_true AS l FROM predictions UNION SELECT y_pred FROM predictions) t CROSS JOIN (SELECT y_true AS l FROM predictions UNION SELECT y_pred FROM predictions) p LEFT JOIN predictions r ON r.y_true = t.l AND r.y_pred = p.l GROUP BY 1, 2", ("predictions",))
def agg_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.confusion(fx.predictions(spark, sf_dir))


_REPORT = """SELECT label, round(prec, 6) AS precision, round(rec, 6) AS recall, round(CASE WHEN prec + rec = 0 THEN 0 ELSE 2 * prec * rec / (prec + rec) END, 6) AS f1, support FROM (
  SELECT l AS label, coalesce(tp / nullif(pred, 0), 0)::DOUBLE AS prec, coalesce(tp / nullif(support, 0), 0)::DOUBLE AS rec, support FROM (
    SELECT l, count(*) FILTER (WHERE y_true = l AND y_pred = l) AS tp, count(*) FILTER (WHERE y_pred = l) AS pred, count(*) FILTER (WHERE y_true = l) AS support
    FROM (SELECT y_true AS l FROM predictions UNION SELECT y_pred FROM predictions) x CROSS JOIN predictions GROUP BY l))"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = dataset.class_report(fx.predictions(spark, sf_dir))
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(_REPORT, ("predictions",))
def agg_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)


@query(f"SELECT round(avg(f1), 4) AS macro_f1 FROM ({_REPORT})", ("predictions",))
def agg_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).agg(F.round(F.avg("f1"), 4).alias("macro_f1"))


@query(f"SELECT 'macro' AS average, round(avg(f1), 4) AS f1, sum(support)::BIGINT AS support FROM ({_REPORT}) UNION ALL SELECT 'weighted', round(sum(f1 * support) / sum(support), 4), sum(support)::BIGINT FROM ({_REPORT})", ("predictions",))
def agg_report_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.report_averages(_report(spark, sf_dir)).select("average", F.round("f1", 4).alias("f1"), "support")


@query(f"SELECT label, f1 FROM ({_REPORT}) ORDER BY f1, label LIMIT 8", ("predictions",))
def topk_worst_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).orderBy("f1", "label").limit(8).select("label", "f1")
