"""A session with the settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "inkfall", master: str | None = None, **conf) -> SparkSession:
    """UTC, adaptive execution with skew joins; the number of shuffle partitions is left to the cluster's settings."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
