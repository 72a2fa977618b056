"""Reports from collected scalars: JSON and Markdown texts."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession

#: Candidates for valuation models and why each is one.
AVM_CANDIDATES = {
    "area_m2": "size", "bedrooms_imputed": "rooms, gaps filled by location", "bathrooms_imputed": "rooms, gaps filled by location",
    "floors_imputed": "height, gaps filled by location",
    "bedrooms_missing": "not told", "bathrooms_missing": "not told", "floors_missing": "not told", "frontage": "street access",
    "province": "regional level", "district": "local level",
    "timeline_hours": "listing age", "district_median_price_million_vnd": "local price level", "district_median_price_per_m2": "local unit price",
    "is_outlier_price": "unusual price",
    "is_outlier_area": "unusual size", "is_outlier_price_per_m2": "unusual unit price", "is_outlier_any": "any of the three",
}


def recommend_features(missing_pct: dict[str, float], strong: dict[str, float]) -> dict[str, Any]:
    rows = [{"feature": f, "missing_pct": float(missing_pct.get(f, 0.0)), "reason": why} for f, why in AVM_CANDIDATES.items()]
    return {"feature_candidates": rows, "strong_numeric_predictors": strong}


def modeling_strategy(missing_pct: dict[str, float]) -> dict[str, Any]:
    filled = ["bedrooms", "bathrooms", "floors"]
    return {  # fixed values: the decisions' names
        "missing_strategy": {
            "decision": "retain_raw_and_use_imputed_plus_missing_flags", "target_columns": filled,
            "imputed_columns": [f"{c}_imputed" for c in filled], "missing_flag_columns": [f"{c}_missing" for c in filled],
            "rule": "district median from 30 observed values on, else province median from 30 on, else the median of all",
            "observed_missing_pct": {c: float(missing_pct.get(c, 0.0)) for c in filled}},
        "outlier_strategy": {
            "decision": "keep_rows_use_flags_and_compare_with_robust_subset",
            "flag_columns": ["is_outlier_price", "is_outlier_area", "is_outlier_price_per_m2", "is_outlier_any"],
            "robust_subset_column": "is_robust_train_candidate"},
    }


def insights(
    target: dict, missing_pct: dict[str, float], corr: dict, duplicates: dict, strong: dict[str, float], reconciled: dict, timeline: list[dict]
) -> list[str]:
    """Every sentence is computed."""
    number = lambda x, form: "n/a" if x is None else format(x, form)
    total = sum(r["listing_count"] for r in timeline) or 1
    largest = max(timeline, key=lambda r: r["listing_count"], default={"time_bucket": "none", "listing_count": 0})
    named = ", ".join(f"{k} ({v:.2f})" for k, v in list(strong.items())[:4])
    return [
        f"Price skewness is {number(target['price_skewness'], '.2f')}, of its log {number(target['log_price_skewness'], '.2f')}.",
        "Missing: " + ", ".join(f"{c} {missing_pct.get(c, 0.0):.2f}%" for c in ("bedrooms", "bathrooms", "floors")) + ".",
        f"Area correlates {number(corr['corr_area_price'], '.3f')} with price and {number(corr['corr_area_ppm2'], '.3f')} with unit price.",
        f"The largest age bucket is {largest['time_bucket']} with {100.0 * largest['listing_count'] / total:.1f}% of listings.",
        f"Repeated listing ids: {duplicates['duplicate_listing_id_rows']}; repeated dedupe keys: {duplicates['duplicate_dedupe_key_rows']}.",
        f"Numeric columns that correlate with price: {named}." if named else "No numeric column correlates 0.2 or more with price.",
        f"Market mart: {reconciled['mismatch_group_count']} of {reconciled['compared_group_count']} groups differ from a rebuild.",
    ]


def told(value: Any) -> str:
    """Whole numbers with thousands separators, ratios of four digits, all else as it is."""
    if isinstance(value, bool) or value is None:
        return str(value)
    return f"{value:,}" if isinstance(value, int) else f"{value:,.4f}".rstrip("0").rstrip(".") if isinstance(value, float) else str(value)


def percent(share: float) -> str:
    return f"{share * 100:.2f}%"


def markdown(title: str, sections: dict[str, Any]) -> str:
    """Lists of dicts as tables, dicts as key lists, lists as bullets."""
    out = [f"# {title}", ""]
    for name, body in sections.items():
        out += [f"## {name}", ""]
        if isinstance(body, dict):
            out += [f"- {k}: {percent(v) if k.endswith('ratio') and v is not None else told(v)}" for k, v in body.items()]
        elif body and isinstance(body[0], dict):
            keys = list(body[0])
            out += ["| " + " | ".join(keys) + " |", "|" + "---|" * len(keys), *("| " + " | ".join(told(r[k]) for k in keys) + " |" for r in body)]
        else:
            out += [f"- {x}" for x in body] if isinstance(body, list) else [str(body)]
        out.append("")
    return "\n".join(out)


def write(spark: SparkSession, folder: str, texts: dict[str, str]) -> None:
    """Texts by file name, through Hadoop's file system of the folder."""
    for file, body in texts.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{str(folder).rstrip('/')}/{file}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()


def save(spark: SparkSession, folder: str, name: str, title: str, sections: dict[str, Any]) -> None:
    """Both texts beside the tables."""
    write(spark, folder, {f"{name}.json": json.dumps(sections, indent=2, default=str, ensure_ascii=False), f"{name}.md": markdown(title, sections)})
