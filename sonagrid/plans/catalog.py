"""The named queries of the library and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonagrid.plans import aggregations, confirmation, datasets, registry, relations, scalars, selections, spatial, streams, training
from sonagrid.plans import more  # isort: skip - it builds on the others

__all__ = ["aggregations", "confirmation", "datasets", "flagship", "more", "oracle_sql", "queries", "relations", "scalars", "selections", "spatial", "streams", "training"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.QUERIES["agg_species_summary"](spark, sf_dir)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
