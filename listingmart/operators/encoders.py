"""Train-time location encoders without leakage, and model frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import median
from ..functions.text import strip
from .quantiles import exact_medians

#: What apply_reference adds, and the predictors.
REFERENCE_COLUMNS = [
    "province_listing_count", "district_listing_count", "province_frequency", "district_frequency", "province_median_price_million_vnd",
    "province_median_price_per_m2",
    "district_median_price_million_vnd", "district_median_price_per_m2", "district_to_province_price_ratio",
    "district_to_province_price_per_m2_ratio",
]
REQUIRED_PREDICTORS = [
    "province", "district", "timeline_bucket", "area_m2", "area_m2_capped_p99", "log_area_m2", "bedrooms_imputed", "bedrooms_missing",
    "bathrooms_imputed", "bathrooms_missing", "floors_imputed",
    "floors_missing", "has_frontage", "timeline_hours_imputed", "timeline_log_hours", "is_new_listing", "total_rooms", "area_per_room",
    "bedroom_density", "bathroom_density", "is_large_property", "is_multi_floor",
]
OPTIONAL_PREDICTORS = [
    "province_frequency", "district_frequency", "province_listing_count", "district_listing_count", "province_median_price_million_vnd",
    "province_median_price_per_m2", "district_median_price_million_vnd",
    "district_median_price_per_m2", "district_to_province_price_ratio", "district_to_province_price_per_m2_ratio", "has_frontage_x_log_area",
    "is_outlier_area",
]
CATEGORICAL = ["province", "district", "timeline_bucket"]
TARGET = "target_log_price_million_vnd"


@dataclass(frozen=True)
class MarketReference:
    """Fitted tables, one row a location, and one row of global values."""

    province: DataFrame
    district: DataFrame
    overall: DataFrame


def normalize_location(df: DataFrame) -> DataFrame:
    """Null becomes Unknown; blanks around names go, an empty name stays empty."""
    return df.withColumns({c: strip(F.coalesce(F.col(c), F.lit("Unknown"))) for c in ("province", "district")})


def _stats(rows: DataFrame, level: str, keys: list[str], price: str, ppm2: str, distributed: bool = False) -> DataFrame:
    if distributed:  # the keys are never null
        medians = exact_medians(rows, keys, {price: f"{level}_median_price_million_vnd", ppm2: f"{level}_median_price_per_m2"})
        return rows.groupBy(*keys).agg(F.count("listing_id").alias(f"{level}_listing_count")).join(medians, keys)
    return rows.groupBy(*keys).agg(
        F.count("listing_id").alias(f"{level}_listing_count"), median(price).alias(f"{level}_median_price_million_vnd"),
        median(ppm2).alias(f"{level}_median_price_per_m2")
    )


def _shares(stats: DataFrame, level: str, total: DataFrame, on: list[str]) -> DataFrame:
    joined = stats.join(F.broadcast(total), on) if on else stats.crossJoin(F.broadcast(total))
    return joined.withColumn(f"{level}_frequency", F.col(f"{level}_listing_count") / F.greatest("total_rows", F.lit(1))).drop("total_rows")


def fit_reference(
    train: DataFrame, price: str = "target_price_million_vnd", ppm2: str = "target_price_per_m2", distributed: bool = False
) -> MarketReference:
    """distributed: medians of provinces and of all rows in a few passes over train (a table, best) that need no reducer
    with all distinct values; districts are many and small."""
    rows = normalize_location(train)
    size = rows.agg(F.count(F.lit(1)).alias("total_rows"))
    if distributed:
        overall = size.crossJoin(exact_medians(rows, [], {price: "global_median_price", ppm2: "global_median_price_per_m2"}))
    else:
        overall = rows.agg(
            F.count(F.lit(1)).alias("total_rows"), median(price).alias("global_median_price"), median(ppm2).alias("global_median_price_per_m2")
        )
    total = size
    return MarketReference(
        _shares(_stats(rows, "province", ["province"], price, ppm2, distributed), "province", total, []),
        _shares(_stats(rows, "district", ["province", "district"], price, ppm2), "district", total, []), overall
    )


def _fill(rows: DataFrame) -> DataFrame:
    """Unseen places: no count, no share, the next wider median; a ratio to zero is 1."""
    c = F.col
    rows = rows.withColumns(
        {
            f"{x}_listing_count": F.coalesce(c(f"{x}_listing_count"), F.lit(0)) for x in ("province", "district")
        } | {f"{x}_frequency": F.coalesce(c(f"{x}_frequency"), F.lit(0.0)) for x in ("province", "district")}
    )
    for name, wide in (("price_million_vnd", "global_median_price"), ("price_per_m2", "global_median_price_per_m2")):
        rows = rows.withColumn(f"province_median_{name}", F.coalesce(c(f"province_median_{name}"), c(wide)))
        rows = rows.withColumn(f"district_median_{name}", F.coalesce(c(f"district_median_{name}"), c(f"province_median_{name}")))
    ratio = lambda name: F.coalesce(F.try_divide(c(f"district_median_{name}"), c(f"province_median_{name}")), F.lit(1.0))
    return rows.withColumns(
        {"district_to_province_price_ratio": ratio("price_million_vnd"), "district_to_province_price_per_m2_ratio": ratio("price_per_m2")}
    ).drop("global_median_price", "global_median_price_per_m2")


def apply_reference(df: DataFrame, ref: MarketReference) -> DataFrame:
    rows = normalize_location(df).join(ref.province, "province", "left").join(ref.district, ["province", "district"], "left")
    return _fill(rows.crossJoin(F.broadcast(ref.overall.drop("total_rows"))))


def fold_of(key: Column, n_splits: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n_splits)).cast("int")


def positional_fold(df: DataFrame, n_splits: int) -> DataFrame:
    """Fold by position in id order, modulo the folds. It numbers all rows in one task: for comparisons of small frames."""
    return df.withColumn("fold", ((F.row_number().over(Window.orderBy("listing_id")) - 1) % n_splits).cast("int"))


def out_of_fold(
    train: DataFrame, n_splits: int = 5, seed: int = 42, fold: Column | None = None, price: str = "target_price_million_vnd",
    ppm2: str = "target_price_per_m2"
) -> DataFrame:
    """listing_id, fold and the reference columns, each row's fitted on the other folds only.

    Medians cannot be made from parts, so each row is dealt to the folds it trains and one grouped pass per level
    serves all folds.
    """
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    if train.limit(n_splits).count() < n_splits:
        raise ValueError("fewer rows than folds")
    rows = normalize_location(train).withColumn("fold", fold_of(F.col("listing_id"), n_splits, seed) if fold is None else fold)
    rows = rows.select("listing_id", "province", "district", "fold", price, ppm2)
    dealt = rows.withColumn(
        "_to", F.explode(F.array_except(F.sequence(F.lit(0), F.lit(n_splits - 1)), F.array("fold")))
    ).drop("fold").withColumnRenamed("_to", "fold")
    overall = dealt.groupBy("fold").agg(
        F.count(F.lit(1)).alias("total_rows"), median(price).alias("global_median_price"), median(ppm2).alias("global_median_price_per_m2")
    )  # a row a fold
    total = overall.select("fold", "total_rows")
    province = _shares(_stats(dealt, "province", ["fold", "province"], price, ppm2), "province", total, ["fold"])
    district = _shares(_stats(dealt, "district", ["fold", "province", "district"], price, ppm2), "district", total, ["fold"])
    out = rows.join(province, ["fold", "province"], "left").join(
        district, ["fold", "province", "district"], "left"
    ).join(F.broadcast(overall.drop("total_rows")), "fold")
    return _fill(out).select("listing_id", "fold", *REFERENCE_COLUMNS)


def predictors(include_optional: bool = True) -> list[str]:
    return REQUIRED_PREDICTORS + (OPTIONAL_PREDICTORS if include_optional else [])


def tree_frame(base: DataFrame, ref: MarketReference, include_optional: bool = True) -> tuple[DataFrame, list[str]]:
    """Id, predictors (categories as text) and target; the categorical columns."""
    return apply_reference(base, ref).select("listing_id", *predictors(include_optional), TARGET), list(CATEGORICAL)


def top_or_other(df: DataFrame, column: str, k: int, out: str) -> DataFrame:
    """The column's k most frequent values (ties by value), Other for the rest."""
    top = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), column).limit(k).select(column, F.lit(True).alias("_top"))
    return df.join(F.broadcast(top), column, "left").withColumn(out, F.when(F.col("_top"), F.col(column)).otherwise("Other")).drop("_top")  # k rows


def linear_frame(base: DataFrame, ref: MarketReference, keep_top: int = 50, include_optional: bool = True, max_levels: int = 1000) -> DataFrame:
    """Id, numeric predictors, one 0/1 column a level of province, kept district and age bucket, and target."""
    rows = top_or_other(apply_reference(base, ref), "district", keep_top, "district_for_ohe")
    places = top_or_other(normalize_location(base.select("province", "district", "timeline_bucket")), "district", keep_top, "district_for_ohe")
    numeric = [c for c in predictors(include_optional) if c not in CATEGORICAL]
    columns = ["province", "district_for_ohe", "timeline_bucket"]
    pairs = places.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns))).alias("x")).select("x.*")
    found = pairs.filter("v is not null").distinct().orderBy("c", "v").limit(max_levels + 1).collect()
    if len(found) > max_levels:
        raise ValueError(f"more than {max_levels} levels")
    hot = [(F.col(c) == r["v"]).cast("int").alias(f"{c}_{r['v']}") for c in columns for r in found if r["c"] == c]
    return rows.select("listing_id", *numeric, *hot, TARGET)


#: The order of calls that keeps prices of test rows out of features.
WORKFLOW = [
    "train, test = split(feature_mart): nothing is fitted before",
    "out_of_fold(train): reference columns of the training rows",
    "apply_reference(test, fit_reference(train)): those of all other rows",
    "tree_frame() or linear_frame(): predictors without the flags that come from prices",
]
