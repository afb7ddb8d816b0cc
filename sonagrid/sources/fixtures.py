"""Canonical tables of the observation model, as views over the test tables.

Each function has a SQL twin in ``SQL`` so that queries can be compared with DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sonagrid.functions.text import json_int


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base_lat(user: str = "device_id"):
    return F.lit(59.9003) + (F.col(user) % 25) * F.lit(0.002)


def _base_lon(user: str = "device_id"):
    return F.lit(41.1007) + (F.col(user) % 20) * F.lit(0.003)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed detections: one row for each event."""
    e = table(spark, sf_dir, "events")
    d = e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("device_id"),
        F.col("event_type").alias("species_slug"),
        F.round(F.least(F.col("value") / 50.0, F.lit(1.0)), 4).alias("confidence"),
        F.col("ts").alias("window_start_ts"),
        (F.col("ts") + F.expr("interval 12 hours")).alias("window_end_ts"),
        json_int("props", "k").alias("k"),
    )
    located = F.col("k") % 20 != 0
    return (
        d.withColumn("lat", F.when(located, _base_lat() + (F.col("k") % 10) * F.lit(0.0003)))
        .withColumn("lon", F.when(located, _base_lon() + (F.col("k") % 7) * F.lit(0.0004)))
        .withColumn("duplicate_of_id", F.lit(None).cast("bigint"))
    )


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("device_id")).agg(F.max("ts").alias("last_seen_at"))
    return e.select(
        "device_id",
        F.concat(F.lit("device "), F.col("device_id").cast("string")).alias("name"),
        (F.col("device_id") % 10 != 0).alias("is_active"),
        F.when(F.col("device_id") % 4 == 0, "mobile").otherwise("stationary").alias("device_type"),
        F.when(F.col("device_id") % 3 != 0, F.lit(60.0)).alias("expected_chunk_sec"),
        _base_lat().alias("lat"),
        _base_lon().alias("lon"),
        "last_seen_at",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded chunks of six hours; ``arrival`` orders them as they came in."""
    e = table(spark, sf_dir, "events").withColumn("k", json_int("props", "k"))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("device_id"),
        F.col("ts").alias("started_at"),
        (F.col("ts") + F.expr("interval 6 hours")).alias("ended_at"),
        (F.col("event_id") + 100 * (F.col("k") % 3)).alias("arrival"),
        F.pmod(F.col("event_id"), F.lit(97)).cast("int").alias("seq"),
        F.sha2(F.col("props"), 256).alias("sha256"),
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis windows of one series for each user, five seconds long."""
    e = table(spark, sf_dir, "events")
    idx = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int")
    conf = F.round(F.least(F.col("value") / 50.0, F.lit(1.0)), 4)
    return e.select(
        F.col("user_id").alias("chunk_id"),
        idx.alias("idx"),
        (idx * F.lit(2.5)).alias("start_sec"),
        (idx * F.lit(2.5) + 5.0).alias("end_sec"),
        F.when(conf >= 0.2, F.col("event_type")).alias("species"),
        conf.alias("prob"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species registry: slug, display name, habitat."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("class_idx"), F.col("n_name").alias("slug"), F.initcap("n_name").alias("ru"), F.lower("r_name").alias("habitat"))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "accepted").when(F.col("o_orderstatus") == "F", "rejected").otherwise("pending")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        status.alias("status"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("species_slug"),
        F.when(F.col("o_orderkey") % 7 == 0, F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderpriority"))).alias("proposed_name"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("duration_sec"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 3 != 0).alias("consent"), F.col("c_acctbal").alias("consent_age"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True and predicted classes of labelled documents."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("y_true"), (F.col("n_chars") > 1000).cast("int").alias("y_pred"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a training set: class, recording, file."""
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("class"), F.concat_ws("_", "lang", "source").alias("recording_id"), F.col("doc_id").alias("file"))


_K = "CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INT)"
_LAT, _LON = "59.9003::DOUBLE + (user_id % 25) * 0.002::DOUBLE", "41.1007::DOUBLE + (user_id % 20) * 0.003::DOUBLE"
_CONF = "round(least(value / 50.0, 1.0), 4)"

#: The same views in DuckDB SQL.
SQL = {
    "detections": f"""SELECT event_id AS id, user_id AS device_id, event_type AS species_slug, {_CONF} AS confidence, ts AS window_start_ts, ts + INTERVAL 12 HOURS AS window_end_ts, k,
      CASE WHEN k % 20 <> 0 THEN ({_LAT})::DOUBLE + (k % 10) * 0.0003::DOUBLE END AS lat, CASE WHEN k % 20 <> 0 THEN ({_LON})::DOUBLE + (k % 7) * 0.0004::DOUBLE END AS lon, NULL::BIGINT AS duplicate_of_id
      FROM (SELECT *, {_K} AS k FROM events)""",
    "devices": f"""SELECT user_id AS device_id, 'device ' || user_id AS name, user_id % 10 <> 0 AS is_active, CASE WHEN user_id % 4 = 0 THEN 'mobile' ELSE 'stationary' END AS device_type,
      CASE WHEN user_id % 3 <> 0 THEN 60.0::DOUBLE END AS expected_chunk_sec, ({_LAT})::DOUBLE AS lat, ({_LON})::DOUBLE AS lon, max(ts) AS last_seen_at FROM events GROUP BY user_id""",
    "chunks": f"""SELECT event_id AS id, user_id AS device_id, ts AS started_at, ts + INTERVAL 6 HOURS AS ended_at, event_id + 100 * ({_K} % 3) AS arrival, CAST(event_id % 97 AS INT) AS seq, sha256(props) AS sha256 FROM events""",
    "windows": f"""SELECT chunk_id, idx, idx * 2.5::DOUBLE AS start_sec, idx * 2.5::DOUBLE + 5 AS end_sec, CASE WHEN prob >= 0.2 THEN event_type END AS species, prob FROM
      (SELECT user_id AS chunk_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS idx, event_type, {_CONF} AS prob FROM events)""",
    "registry": """SELECT n_nationkey AS class_idx, n_name AS slug, (SELECT string_agg(upper(left(w, 1)) || lower(substr(w, 2)), ' ' ORDER BY o) FROM unnest(string_split(n_name, ' ')) WITH ORDINALITY AS u(w, o)) AS ru, lower(r_name) AS habitat FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "submissions": """SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderstatus WHEN 'O' THEN 'accepted' WHEN 'F' THEN 'rejected' ELSE 'pending' END AS status,
      CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS species_slug, CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END END AS proposed_name,
      o_orderdate AS created_at, o_totalprice AS duration_sec FROM orders""",
    "users": "SELECT c_custkey AS user_id, c_name AS name, c_custkey % 3 <> 0 AS consent, c_acctbal AS consent_age FROM customer",
    "predictions": "SELECT l.doc_id, quality AS y_true, CAST(n_chars > 1000 AS INT) AS y_pred FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
    "recordings": 'SELECT lang AS "class", lang || \'_\' || source AS recording_id, doc_id AS file FROM documents',
}


def with_views(body: str, *names: str) -> str:
    """``body`` with the named views as common table expressions."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + body
