"""Valuation mart: three-level imputation, outlier fences, location ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import MART, bucket
from ..functions.stats import fences, lower_median, median, quantiles
from ..operators.quantiles import exact_quantiles

IMPUTED = ("bedrooms", "bathrooms", "floors")
FENCED = {"price": "price_million_vnd", "area": "area_m2", "price_per_m2": "price_per_m2"}
MIN_OBSERVED = 30


def observed_stats(fact: DataFrame, level: str, keys: list[str], medians: bool = False) -> DataFrame:
    """Observed counts and lower medians of the imputed columns by keys; price medians too if asked for."""
    aggs = [x for c in IMPUTED for x in (F.count(c).alias(f"{level}_{c}_count"), lower_median(c).alias(f"{level}_median_{c}"))]
    if medians:
        aggs += [median(c).alias(f"{level}_median_{c}") for c in ("price_million_vnd", "price_per_m2")]
    return fact.groupBy(*keys).agg(*aggs) if keys else fact.agg(*aggs)


def impute(rows: DataFrame, min_observed: int = MIN_OBSERVED) -> DataFrame:
    """Own value, else the median of the district, of the province (each from enough observed values), of all."""
    for c in IMPUTED:
        enough = [F.when(F.col(f"{level}_{c}_count") >= min_observed, F.col(f"{level}_median_{c}")) for level in ("district", "province")]
        rows = rows.withColumn(f"{c}_missing", F.col(c).isNull()).withColumn(
            f"{c}_imputed", F.coalesce(F.col(c), *enough, F.col(f"global_median_{c}"))
        )
    return rows


def bounds(fact: DataFrame, distributed: bool = False) -> DataFrame:
    """One row: quartiles of the fenced columns. distributed: in two passes over fact (a table, best) that need no
    reducer with all distinct values; else one aggregate."""
    if distributed:
        q = exact_quantiles(fact, {c: (0.25, 0.75) for c in FENCED.values()}).withColumnsRenamed({c: name for name, c in FENCED.items()})
    else:
        q = fact.agg(*(quantiles(c, (0.25, 0.75)).alias(name) for name, c in FENCED.items()))
    return q.select(*(F.get(name, F.lit(k)).alias(f"{name}_q{1 + 2 * k}") for name in FENCED for k in (0, 1)))


def iqr_bounds(fact: DataFrame) -> DataFrame:
    rows = bounds(fact)
    cols = {}
    for name in FENCED:
        low, high = fences(F.col(f"{name}_q1"), F.col(f"{name}_q3"))
        cols |= {f"{name}_low": low, f"{name}_high": high}
    return rows.withColumns(cols)


def flag_outliers(rows: DataFrame) -> DataFrame:
    """Strictly outside the fences; rows carry the quartiles."""
    flags = {}
    for name, c in FENCED.items():
        low, high = fences(F.col(f"{name}_q1"), F.col(f"{name}_q3"))
        flags[f"is_outlier_{name}"] = (F.col(c) < low) | (F.col(c) > high)
    rows = rows.withColumns(flags)
    any_ = F.col("is_outlier_price") | F.col("is_outlier_area") | F.col("is_outlier_price_per_m2")
    return rows.withColumn("is_outlier_any", any_).withColumn("is_robust_train_candidate", ~any_)


def avm_mart(fact: DataFrame, dim: DataFrame, distributed: bool = False) -> DataFrame:
    """Statistics are computed once a level and joined back; all joined sides hold one row a location or one row."""
    district = observed_stats(fact, "district", ["province", "district"], medians=True)
    province = observed_stats(fact, "province", ["province"])
    one = observed_stats(fact, "global", []).crossJoin(bounds(fact, distributed))
    rows = fact.withColumn("time_bucket", bucket(F.col("timeline_hours"), MART)).crossJoin(F.broadcast(one))  # one row
    rows = rows.join(district, ["province", "district"], "left").join(province, "province", "left").join(dim, ["province", "district"], "left")
    rows = flag_outliers(impute(rows))
    filled = [x for c in IMPUTED for x in (c, f"{c}_missing", f"{c}_imputed")]
    return rows.select(
        "listing_id", "location_id", "province", "district", "timeline_hours", "time_bucket", "area_m2", *filled, "frontage",
        "district_median_price_million_vnd", "district_median_price_per_m2",
        *(f"is_outlier_{x}" for x in ("price", "area", "price_per_m2", "any")), "is_robust_train_candidate",
        F.col("price_million_vnd").alias("target_price_million_vnd"), F.col("price_per_m2").alias("target_price_per_m2"))
