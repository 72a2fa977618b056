"""Market mart: medians and counts by province, district and age bucket; and its reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import MART, bucket
from ..functions.stats import median

KEYS = ["province", "district", "time_bucket"]


def market_mart(fact: DataFrame) -> DataFrame:
    rows = fact.select("province", "district", bucket(F.col("timeline_hours"), MART).alias("time_bucket"), "price_million_vnd", "price_per_m2")
    return rows.groupBy(*KEYS).agg(
        median("price_million_vnd").alias("median_price_million_vnd"), median("price_per_m2").alias("median_price_per_m2"),
        F.count(F.lit(1)).alias("listing_count")
    )


def reconcile(mart: DataFrame, fact: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Every group of the mart or of a rebuild, with whether they differ."""
    values = ["listing_count", "median_price_million_vnd", "median_price_per_m2"]
    rebuilt = market_mart(fact).withColumnsRenamed({c: f"{c}_fact" for c in values}).withColumn("_f", F.lit(True))
    both = mart.select(*KEYS, *values).withColumn("_m", F.lit(True)).join(rebuilt, KEYS, "full_outer")
    filled = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0))
    differs = F.col("_m").isNull() | F.col("_f").isNull() | (filled("listing_count") != filled("listing_count_fact"))
    for c in values[1:]:
        differs = differs | (F.abs(filled(c) - filled(f"{c}_fact")) > eps)
    return both.withColumn("is_mismatch", differs).drop("_m", "_f")


def reconcile_counts(mart: DataFrame, fact: DataFrame) -> DataFrame:
    return reconcile(mart, fact).agg(F.count_if("is_mismatch").alias("mismatch_group_count"), F.count(F.lit(1)).alias("compared_group_count"))
