"""Table schemas and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

#: The columns of a raw listing file, in order.
RAW_COLUMNS = [
    "id", "detail_url", "title", "location", "timeline_hours", "area_m2", "bedrooms", "bathrooms", "floors", "frontage", "price_million_vnd"
]
#: Texts that a raw file's reader takes for missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null"
]
INT_COLUMNS = ["timeline_hours", "bedrooms", "bathrooms", "floors"]
FLOAT_COLUMNS = ["area_m2", "price_million_vnd"]


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _I, _L, _D, _B, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType()

#: The tables' columns, in order.
RAW_TEXT = T.StructType([T.StructField(c, _S) for c in RAW_COLUMNS])
STAGING = _schema(
    id=_S, detail_url=_S, title=_S, location=_S, timeline_hours=_I, area_m2=_D, bedrooms=_I, bathrooms=_I, floors=_I, frontage=_D,
    price_million_vnd=_D
)
FACT = _schema(
    listing_id=_S, detail_url=_S, title=_S, province=_S, district=_S, timeline_hours=_I, area_m2=_D, bedrooms=_I, bathrooms=_I, floors=_I,
    frontage=_D, price_million_vnd=_D, price_per_m2=_D
)
DIM_LOCATION = _schema(location_id=_I, province=_S, district=_S)
MARKET_MART = _schema(
    province=_S, district=_S, time_bucket=_S, median_price_million_vnd=_D, median_price_per_m2=_D, listing_count=_L, refreshed_at=_TS
)
AVM_MART = _schema(
    listing_id=_S, location_id=_I, province=_S, district=_S, timeline_hours=_I, time_bucket=_S, area_m2=_D, bedrooms=_I, bedrooms_missing=_B,
    bedrooms_imputed=_I,
    bathrooms=_I, bathrooms_missing=_B, bathrooms_imputed=_I, floors=_I, floors_missing=_B, floors_imputed=_I, frontage=_D,
    district_median_price_million_vnd=_D, district_median_price_per_m2=_D, is_outlier_price=_B, is_outlier_area=_B, is_outlier_price_per_m2=_B,
    is_outlier_any=_B,
    is_robust_train_candidate=_B, target_price_million_vnd=_D, target_price_per_m2=_D, refreshed_at=_TS)
FEATURE_MART = _schema(
    listing_id=_S, location_id=_I, province=_S, district=_S, province_listing_count_ref=_I, district_listing_count_ref=_I, province_frequency_ref=_D,
    district_frequency_ref=_D,
    province_median_price_million_vnd_ref=_D, province_median_price_per_m2_ref=_D, district_median_price_million_vnd_ref=_D,
    district_median_price_per_m2_ref=_D,
    district_to_province_price_ratio_ref=_D, district_to_province_price_per_m2_ratio_ref=_D,
    timeline_hours=_I, timeline_missing=_B, timeline_hours_imputed=_I, timeline_hours_capped_p99=_D, timeline_days_imputed=_D, timeline_log_hours=_D,
    timeline_bucket=_S,
    is_new_listing=_B, is_stale_listing=_B, area_m2=_D, area_m2_capped_p99=_D, log_area_m2=_D, bedrooms_imputed=_I, bedrooms_missing=_B,
    bedrooms_capped_p99=_D,
    bathrooms_imputed=_I, bathrooms_missing=_B, bathrooms_capped_p99=_D, floors_imputed=_I, floors_missing=_B, floors_capped_p99=_D, frontage_raw=_D,
    frontage_missing=_B,
    has_frontage=_B, total_rooms=_I, area_per_room=_D, bedroom_density=_D, bathroom_density=_D, has_frontage_x_log_area=_D, is_large_property=_B,
    is_multi_floor=_B,
    is_outlier_area=_B, is_outlier_price=_B, is_outlier_price_per_m2=_B, is_outlier_any=_B, is_robust_train_candidate=_B,
    target_price_million_vnd=_D, target_log_price_million_vnd=_D, target_price_per_m2=_D, target_log_price_per_m2=_D, feature_version=_S,
    refreshed_at=_TS)
RUN_LOG = _schema(
    run_id=_L, pipeline_name=_S, started_at=_TS, finished_at=_TS, status=_S, raw_source_rows=_L, raw_landing_rows=_L, staging_rows=_L, fact_rows=_L,
    mart_market_analytics_rows=_L, mart_avm_features_rows=_L, quality_metrics=_S, thresholds=_S, error_message=_S, sequence=_I)
DIM_TIME = _schema(date_id=_I, full_date=T.DateType(), year=_I, quarter=_I, month=_I, week=_I)
