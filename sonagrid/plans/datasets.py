"""Training-set operators (inventory 2.15)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sonagrid.operators import dataset, export
from sonagrid.plans.registry import query
from sonagrid.sources import fixtures as fx
from sonagrid.sources.shared import shared_folder

_R = ("recordings",)
_SPLIT = """(SELECT r.*, CASE WHEN n = 1 THEN 'train' WHEN n = 2 THEN CASE WHEN k = 1 THEN 'train' ELSE 'val' END WHEN k <= nt THEN 'test' WHEN k <= nt + nv THEN 'val' ELSE 'train' END AS split
  FROM recordings r JOIN (SELECT "class", recording_id, n, k, CASE WHEN 2 * m < n THEN m ELSE 1 END AS nt, CASE WHEN 2 * m < n THEN m ELSE 1 END AS nv FROM (
    SELECT *, greatest(1, round_even(n * 0.15, 0))::INT AS m FROM (SELECT "class", recording_id, count(*) OVER (PARTITION BY "class") AS n, row_number() OVER (PARTITION BY "class" ORDER BY recording_id) AS k FROM (SELECT DISTINCT "class", recording_id FROM recordings)))) x
  ON x.recording_id = r.recording_id AND x."class" = r."class")"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.group_split(fx.recordings(spark, sf_dir), seed=None)


@query(f'SELECT "class", recording_id, file, split FROM {_SPLIT}', _R)
def ml_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("class", "recording_id", "file", "split")


@query(f'SELECT "class", split, count(*) AS files, count(DISTINCT recording_id) AS recordings FROM {_SPLIT} GROUP BY 1, 2', _R)
def agg_split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.split_stats(_split(spark, sf_dir))


@query('SELECT "class", recording_id, 0::BIGINT AS parts FROM recordings WHERE FALSE', _R)
def set_split_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.leaking_recordings(dataset.group_split(fx.recordings(spark, sf_dir)))


@query('SELECT "class", CAST(row_number() OVER (ORDER BY "class") - 1 AS INT) AS idx FROM (SELECT DISTINCT "class" FROM recordings)', _R)
def ml_label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.label_index(fx.recordings(spark, sf_dir))


@query('SELECT file, r."class", 1.0::DOUBLE / n AS weight FROM recordings r JOIN (SELECT "class", count(*) AS n FROM recordings GROUP BY 1) c ON c."class" = r."class"', _R)
def ml_sampling_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.sampling_weights(fx.recordings(spark, sf_dir)).select("file", "class", "weight")


@query('SELECT DISTINCT "class", CASE WHEN "class" = \'es\' THEN \'special\' WHEN "class" IN (\'en\', \'de\') THEN \'valid\' ELSE \'invalid\' END AS verdict FROM recordings', _R)
def agg_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = spark.createDataFrame([("en",), ("de",)], "slug string")
    return dataset.validation_report(fx.recordings(spark, sf_dir), white, ("es",))


@query(f'SELECT split, count(*) AS n FROM {_SPLIT} GROUP BY 1', _R)
def snk_split_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifests as written, read back."""
    folder = f"{shared_folder(spark)}/split-{uuid.uuid4().hex}"
    export.write_split(_split(spark, sf_dir), folder)
    return spark.read.schema("class string, recording_id string, file long, split string").json(folder).groupBy("split").agg(F.count("file").alias("n"))
