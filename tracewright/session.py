"""Spark session with the settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "tracewright", master: str | None = None, **conf: str) -> SparkSession:
    """Session in UTC with adaptive execution; on a cluster the submit settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
