"""Session settings that every query in the library relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build(app: str = "sonagrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; other settings come from ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def share_code(spark: SparkSession) -> None:
    """Lets Python workers of this machine import the library from where the driver
    found it. On a cluster the package is installed, or sent with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])
