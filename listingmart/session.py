"""The session the warehouse expects: ANSI, adaptive execution, UTC."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "listingmart", master: str | None = None, **conf: str) -> SparkSession:
    """conf: further settings, dots written as double underscores. Shuffle partitions are left to AQE to coalesce."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
