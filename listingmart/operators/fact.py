"""Staging rows to facts, and the dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.location import blank_to_null, extract_location, known
from ..functions.text import strip
from ..schemas import FACT


class DuplicateListingError(ValueError):
    """Two URLs carry one listing id."""


def valid(staging: DataFrame) -> DataFrame:
    """Known id, price and area above zero. It must come before dedupe: an invalid fresher row must not win."""
    return staging.filter(F.col("id").isNotNull() & (F.col("price_million_vnd") > 0) & (F.col("area_m2") > 0))


def dedupe_key(url: str = "detail_url", key: str = "id") -> Column:
    return F.coalesce(blank_to_null(strip(F.col(url))), F.concat(F.lit("id:"), F.col(key)))


def completeness() -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in ("bedrooms", "bathrooms", "floors", "frontage")), F.lit(0))


def dedupe_latest(staging: DataFrame) -> DataFrame:
    """One row a key: freshest, most complete, smallest id; then by all other columns, so reruns agree. A key's hash leads,
    which sorts faster than texts with one beginning."""
    rest = [c for c in staging.columns if c not in ("id", "timeline_hours")]
    order = [F.asc_nulls_last("timeline_hours"), F.desc("_complete"), F.asc("id"), *(F.asc_nulls_first(c) for c in rest)]
    ranked = staging.withColumns({"_key": dedupe_key(), "_complete": completeness()}).withColumn("_hash", F.xxhash64("_key"))
    first = F.row_number().over(Window.partitionBy("_hash", "_key").orderBy(*order))
    return ranked.withColumn("_n", first).filter("_n = 1").drop("_n", "_hash", "_key", "_complete")


def conflicting_ids(deduped: DataFrame) -> DataFrame:
    """Ids that more than one row carries."""
    return deduped.groupBy("id").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def check_ids(deduped: DataFrame) -> None:
    found = [r["id"] for r in conflicting_ids(deduped).orderBy("id").limit(10).collect()]
    if found:
        raise DuplicateListingError(f"listing ids on several rows after dedupe: {found}")


def build_fact(staging: DataFrame, strict_prefix: bool = False, check: bool = True) -> DataFrame:
    rows = dedupe_latest(valid(staging))
    if check:
        check_ids(rows)
    province, district = extract_location(F.col("location"), strict_prefix)
    out = rows.withColumns({
        "listing_id": F.col("id"), "province": known(province), "district": known(district), "detail_url": blank_to_null(strip(F.col("detail_url"))),
        "price_per_m2": F.col("price_million_vnd") / F.col("area_m2")})
    return out.select(*(f.name for f in FACT))


def dim_location(fact: DataFrame) -> DataFrame:
    """Numbered in binary order. The distinct pairs are few, so one task may number them."""
    pairs = fact.select("province", "district").distinct()
    return pairs.select(F.row_number().over(Window.orderBy("province", "district")).alias("location_id"), "province", "district")


def dim_time(first: str, last: str, spark) -> DataFrame:
    day = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day")))
    days = spark.range(1).select(day.alias("full_date"))
    return days.select(
        F.date_format("full_date", "yyyyMMdd").cast("int").alias("date_id"), "full_date", F.year("full_date").alias("year"),
        F.quarter("full_date").alias("quarter"), F.month("full_date").alias("month"), F.weekofyear("full_date").alias("week")
    )


def add_missing(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key the table lacks, to be appended."""
    return rows.join(table.select(key), key, "left_anti")
