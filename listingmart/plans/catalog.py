"""Feature catalog and modelling guidance as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Input column, group, decision. The notes are this package's.
INPUT_REVIEW = [
    ("area_m2", "numeric", "keep_and_transform"), ("bedrooms", "numeric", "exclude_raw"), ("bathrooms", "numeric", "exclude_raw"),
    ("floors", "numeric", "exclude_raw"),
    ("frontage", "numeric", "reinterpret_as_boolean"), ("timeline_hours", "numeric", "keep_and_transform"),
    ("province", "categorical", "keep_and_encode"), ("district", "categorical", "keep_and_encode"),
    ("district_median_price_million_vnd", "derived", "reuse_with_leakage_control"),
    ("district_median_price_per_m2", "derived", "reuse_with_leakage_control"), ("is_outlier_area", "derived", "optional_predictor"),
    ("is_outlier_price", "derived", "analysis_only"), ("is_outlier_price_per_m2", "derived", "analysis_only"),
    ("is_outlier_any", "derived", "analysis_or_filter_only"), ("target_price_million_vnd", "target", "keep_target"),
]
INPUT_NOTES = {
    "area_m2": "always known in the fact; a log and a capped copy go beside it", "bedrooms": "gaps; the mart has a filled copy and a flag",
    "bathrooms": "gaps; the mart has a filled copy and a flag",
    "floors": "gaps; the mart has a filled copy and a flag", "frontage": "0, 1 or unknown: read as has_frontage",
    "timeline_hours": "gaps take the median; hours, log, days and a bucket are kept",
    "province": "few values: one column each or a category", "district": "many values: counts, shares and medians, or the most frequent ones",
    "district_median_price_million_vnd": "holds prices, so fit it on training rows",
    "district_median_price_per_m2": "holds prices, so fit it on training rows", "is_outlier_area": "from the area alone",
    "is_outlier_price": "from the price that is to be predicted", "is_outlier_price_per_m2": "from the price that is to be predicted",
    "is_outlier_any": "price flags are in it", "target_price_million_vnd": "what predictions are read back to",
}
#: Feature, decision.
NUMERIC_TRANSFORMS = [
    ("area_m2", "keep_raw_plus_log_plus_cap"), ("bedrooms_imputed", "keep_raw_plus_cap"), ("bathrooms_imputed", "keep_raw_plus_cap"),
    ("floors_imputed", "keep_raw_plus_cap"),
    ("timeline_hours", "keep_raw_plus_log_plus_bucket"), ("frontage", "convert_to_has_frontage"),
]
NUMERIC_REASONS = {
    "area_m2": "a few very large plots stretch the scale", "bedrooms_imputed": "a count; the cap is its 99th percentile",
    "bathrooms_imputed": "a count; the cap is its 99th percentile",
    "floors_imputed": "a count; the cap is its 99th percentile", "timeline_hours": "early hours matter more than late ones",
    "frontage": "no width is known, only that there is one",
}
#: Feature, use.
TIME_FEATURES = [
    ("timeline_hours_imputed", "AVM and analytics"), ("timeline_log_hours", "AVM"), ("timeline_bucket", "AVM and analytics"),
    ("is_new_listing", "AVM and analytics"), ("is_stale_listing", "AVM and analytics"),
]
TIME_REASONS = {
    "timeline_hours_imputed": "age without gaps", "timeline_log_hours": "age on a scale of ratios", "timeline_bucket": "age as a category",
    "is_new_listing": "under three days", "is_stale_listing": "over thirty days",
}
#: The features a model must, may and must not use.
REQUIRED = [
    "area_m2", "area_m2_capped_p99", "log_area_m2", "bedrooms_imputed", "bedrooms_missing", "bathrooms_imputed", "bathrooms_missing",
    "floors_imputed", "floors_missing", "has_frontage", "timeline_hours_imputed",
    "timeline_log_hours", "timeline_bucket", "is_new_listing", "province", "district", "total_rooms", "area_per_room", "bedroom_density",
    "bathroom_density", "is_large_property", "is_multi_floor",
]
OPTIONAL = [
    "province_frequency_ref", "district_frequency_ref", "province_listing_count_ref", "district_listing_count_ref",
    "province_median_price_million_vnd_ref", "province_median_price_per_m2_ref",
    "district_median_price_million_vnd_ref", "district_median_price_per_m2_ref", "district_to_province_price_ratio_ref",
    "district_to_province_price_per_m2_ratio_ref", "timeline_hours_capped_p99",
    "bedrooms_capped_p99", "bathrooms_capped_p99", "floors_capped_p99", "has_frontage_x_log_area", "is_outlier_area",
]
EXCLUDED = [
    "bedrooms", "bathrooms", "floors", "frontage_raw", "target_price_per_m2", "target_log_price_per_m2", "is_outlier_price",
    "is_outlier_price_per_m2", "is_outlier_any", "is_robust_train_candidate",
]
TARGET = {
    "transformed_target": "target_log_price_million_vnd", "raw_target": "target_price_million_vnd",
    "advice": "Train on log(1 + price). exp(prediction) - 1 is a price again; state errors in prices.",
}
ENCODING = {
    "categories": "tree_frame() passes them as texts, linear_frame() as 0/1 columns with all but the most frequent districts as Other",
    "places": "apply_reference() adds counts, shares and medians that fit_reference() took from training rows",
}
LEAKAGE = {
    "reference columns (_ref)": "taken over all rows, prices of test rows too: for display and for scoring new listings",
    "training rows": "out_of_fold() gives each row values from the other folds",
    "test rows": "apply_reference() of a table that was fitted without them",
    "price flags": "known only where the price is; filter with them, do not predict from them",
}


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    groups = [(f, g) for g, names in (("required", REQUIRED), ("optional", OPTIONAL), ("excluded", EXCLUDED)) for f in names]
    noted = lambda rows, notes: [(*r, notes[r[0]]) for r in rows]
    return {
        "input_feature_review": spark.createDataFrame(noted(INPUT_REVIEW, INPUT_NOTES), "column string, `group` string, action string, notes string"),
        "numeric_transformations": spark.createDataFrame(noted(NUMERIC_TRANSFORMS, NUMERIC_REASONS), "feature string, decision string, why string"),
        "time_features": spark.createDataFrame(noted(TIME_FEATURES, TIME_REASONS), "feature string, use_for string, why string"),
        "final_features": spark.createDataFrame(groups, "feature string, `group` string"),
    }
