"""Model-ready feature mart over the valuation mart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import USER, bucket
from ..functions.stats import median, quantiles
from ..operators.quantiles import exact_medians, exact_quantiles

VERSION = "phase3_v1"
TARGETS = {"price_million_vnd": "target_price_million_vnd", "price_per_m2": "target_price_per_m2"}


def refs(avm: DataFrame, level: str, keys: list[str], total: DataFrame, distributed: bool = False) -> DataFrame:
    """Count, share of all rows and target medians by keys; distributed: no reducer holds a group's distinct values."""
    names, count = {t: f"{level}_median_{n}_ref" for n, t in TARGETS.items()}, F.count(F.lit(1)).alias(f"{level}_listing_count_ref")
    if distributed:
        found = exact_medians(avm, keys, names).withColumnsRenamed({k: f"{k}_" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
        out = avm.groupBy(*keys).agg(count).join(found, same).drop(*(f"{k}_" for k in keys))
    else:
        out = avm.groupBy(*keys).agg(count, *(median(t).alias(n) for t, n in names.items()))
    share = F.col(f"{level}_listing_count_ref") / F.nullif(F.col("_total"), F.lit(0))
    return out.crossJoin(F.broadcast(total)).withColumn(f"{level}_frequency_ref", share).drop("_total")


QUANTILES = {
    "timeline_hours": (0.5, 0.99), "area_m2": (0.5, 0.75, 0.99), "bedrooms_imputed": (0.99,), "bathrooms_imputed": (0.99,), "floors_imputed": (0.99,)
}


def feature_quantiles(avm: DataFrame, distributed: bool = False) -> DataFrame:
    """One row; all quantiles of a column come from one aggregate, or (distributed) from two passes without a large reducer."""
    q = exact_quantiles(avm, QUANTILES) if distributed else avm.agg(*(quantiles(c, p).alias(c) for c, p in QUANTILES.items()))
    names = {
        "timeline_p50": ("timeline_hours", 0), "timeline_p99": ("timeline_hours", 1), "area_p50": ("area_m2", 0), "area_p75": ("area_m2", 1),
        "area_p99": ("area_m2", 2)
    }
    names |= {f"{c}_p99": (f"{c}_imputed", 0) for c in ("bedrooms", "bathrooms", "floors")}
    return q.select(*(F.get(c, F.lit(k)).alias(name) for name, (c, k) in names.items()))


def feature_mart(avm: DataFrame, distributed: bool = False) -> DataFrame:
    c = F.col
    total = avm.agg(F.count(F.lit(1)).alias("_total"))
    rows = avm.crossJoin(F.broadcast(feature_quantiles(avm, distributed)))  # one row
    rows = rows.join(refs(avm, "province", ["province"], total, distributed), "province", "left").join(
        refs(avm, "district", ["province", "district"], total), ["province", "district"], "left"
    )
    ratio = lambda name: F.try_divide(c(f"district_median_{name}_ref"), c(f"province_median_{name}_ref"))
    hours = F.coalesce(c("timeline_hours").cast("double"), c("timeline_p50"))
    rounded = F.coalesce(c("timeline_hours"), F.rint("timeline_p50").cast("int"))
    rooms = c("bedrooms_imputed") + c("bathrooms_imputed")
    frontage = F.coalesce(c("frontage"), F.lit(0.0)) > 0
    log_area = F.log1p("area_m2")
    capped = lambda name: F.least(c(f"{name}_imputed").cast("double"), c(f"{name}_p99")).alias(f"{name}_capped_p99")
    counts = [x for n in ("bedrooms", "bathrooms", "floors") for x in (c(f"{n}_imputed"), c(f"{n}_missing"), capped(n))]
    return rows.select(
        "listing_id", "location_id", "province", "district",
        c("province_listing_count_ref").cast("int").alias("province_listing_count_ref"),
        c("district_listing_count_ref").cast("int").alias("district_listing_count_ref"), "province_frequency_ref", "district_frequency_ref",
        *(f"{level}_median_{n}_ref" for level in ("province", "district") for n in TARGETS),
        ratio("price_million_vnd").alias("district_to_province_price_ratio_ref"),
        ratio("price_per_m2").alias("district_to_province_price_per_m2_ratio_ref"),
        "timeline_hours", c("timeline_hours").isNull().alias("timeline_missing"), rounded.alias("timeline_hours_imputed"),
        F.least(hours, c("timeline_p99")).alias("timeline_hours_capped_p99"),
        (hours / 24.0).alias("timeline_days_imputed"), F.log1p(hours).alias("timeline_log_hours"),
        bucket(c("timeline_hours"), USER).alias("timeline_bucket"),
        (rounded < 72).alias("is_new_listing"), (rounded > 720).alias("is_stale_listing"),
        "area_m2", F.least("area_m2", "area_p99").alias("area_m2_capped_p99"), log_area.alias("log_area_m2"), *counts,
        c("frontage").alias("frontage_raw"), c("frontage").isNull().alias("frontage_missing"), frontage.alias("has_frontage"),
        rooms.alias("total_rooms"), F.try_divide(c("area_m2"), F.greatest(rooms, F.lit(1)).cast("double")).alias("area_per_room"),
        F.try_divide(c("bedrooms_imputed").cast("double"), c("area_m2")).alias("bedroom_density"),
        F.try_divide(c("bathrooms_imputed").cast("double"), c("area_m2")).alias("bathroom_density"),
        F.when(frontage, log_area).otherwise(0.0).alias("has_frontage_x_log_area"), (c("area_m2") >= c("area_p75")).alias("is_large_property"),
        (c("floors_imputed") >= 2).alias("is_multi_floor"),
        "is_outlier_area", "is_outlier_price", "is_outlier_price_per_m2", "is_outlier_any", "is_robust_train_candidate",
        "target_price_million_vnd", F.log1p("target_price_million_vnd").alias("target_log_price_million_vnd"), "target_price_per_m2",
        F.log1p("target_price_per_m2").alias("target_log_price_per_m2"),
        F.lit(VERSION).alias("feature_version"))
