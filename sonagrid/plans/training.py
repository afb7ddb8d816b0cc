"""Draws, augmentation and pairing of training rows (2.9 audio, 2.15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sonagrid.operators import augment, dataset
from sonagrid.plans.registry import query
from sonagrid.sources import fixtures as fx


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"))


@query()
def ml_weighted_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many files as there are, drawn so that classes come equally often."""
    files = dataset.sampling_weights(fx.recordings(spark, sf_dir)).select("file", "class", "weight")
    found = augment.drawn(files, "file", F.col("weight"), files.count(), seed=7)
    return found.join(files.select("file", "class"), "file")


@query()
def aug_waveform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augment.waveforms(_arrays(spark, sf_dir), "vec_id", seed=7)


@query()
def aug_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays read as spectrograms of eight bands."""
    return augment.masked(_arrays(spark, sf_dir).select("vec_id", F.col("samples").alias("mel")), "vec_id", 8, seed=7)


_A = "CASE WHEN n % 1000039 <> 0 THEN 1000039 WHEN n % 1000003 <> 0 THEN 1000003 ELSE 1000033 END"


@query(f"WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS rank, count(*) OVER () AS n FROM embeddings) SELECT a.vec_id, b.vec_id AS other FROM r a JOIN r b ON b.rank = (({_A.replace('n %', 'a.n %')}) * a.rank + 7 * 7919) % a.n")
def aug_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augment.partners(_arrays(spark, sf_dir), "vec_id", seed=7)


@query()
def aug_mixup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _arrays(spark, sf_dir).withColumn("label", F.col("vec_id") % 16)
    return augment.mixed(rows, "vec_id", "samples", "label", seed=7)
