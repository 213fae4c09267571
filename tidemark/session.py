"""A Spark session with the settings that the library's results assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, Arrow. Partition counts and memory are the cluster's business."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
