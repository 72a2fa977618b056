"""The entry points: load, explore, make features, profile."""

from __future__ import annotations

import argparse
import os
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import checks, quality
from ..operators.fact import build_fact, dim_location
from ..operators.staging import build_staging
from ..schemas import AVM_MART, DIM_LOCATION, FACT, FEATURE_MART, MARKET_MART, RAW_TEXT, STAGING
from ..session import build
from ..sources.csvfile import raw_landing, read_raw_text
from ..sources.tables import Warehouse, write_csv
from . import avm, catalog, eda, features, figures, market, profile, report


def stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("refreshed_at", F.current_timestamp().cast("timestamp_ntz"))


def run_load(
    spark: SparkSession, raw: DataFrame, root: str, limits: quality.Thresholds | None = None, skip_marts: bool = False, skip_gate: bool = False
) -> dict:
    """Raw texts to fact, dimension and marts, with a run log. Raw and staging land before the fact is built or the gate
    speaks, so a failure of either leaves them to look at."""
    house, limits = Warehouse(spark, root), limits or quality.Thresholds()
    log = quality.RunLog(house)
    run, counts, found = log.start("phase1_etl", limits), {}, None
    try:
        landed = house.replace(raw_landing(raw), "stg_listings_raw_text", RAW_TEXT)
        staging = house.replace(build_staging(landed), "stg_listings_raw", STAGING)
        counts = {"raw_source_rows": raw.count(), "raw_landing_rows": landed.count(), "staging_rows": staging.count()}
        fact = build_fact(staging)
        found = quality.metrics(staging, fact)
        if not skip_gate:
            quality.enforce(found, limits)
        fact = house.replace(fact, "fact_listings", FACT)
        dim = house.replace(dim_location(fact), "dim_location", DIM_LOCATION)
        counts["fact_rows"] = fact.count()
        if not skip_marts:
            counts["mart_market_analytics_rows"] = house.replace(stamped(market.market_mart(fact)), "mart_market_analytics", MARKET_MART).count()
            counts["mart_avm_features_rows"] = house.replace(
                stamped(avm.avm_mart(fact, dim, distributed=True)), "mart_avm_features", AVM_MART
            ).count()
    except Exception as e:
        log.finish(run, "failed", counts, found, str(e)[:2000])
        raise
    log.finish(run, "success", counts, found)
    return {**run, **counts, "quality_metrics": found}


def load_data(house: Warehouse) -> tuple[DataFrame, DataFrame]:
    """Fact and market mart for the analyses: places filled and stripped, URLs filled."""
    place = {c: strip(F.coalesce(F.col(c), F.lit("Unknown"))) for c in ("province", "district")}
    fact = house.read("fact_listings").withColumns(place | {"detail_url": F.coalesce("detail_url", F.lit(""))})
    return fact, house.read("mart_market_analytics").withColumns(place)


def draw(fact: DataFrame, tables: dict[str, DataFrame], timeline: list[dict]) -> dict[str, str]:
    """Figures by file name. All that is collected is an aggregate or the scatter's bounded sample."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    bins = lambda df, column, n=60: rows(eda.histogram(df, column, n))
    logged = fact.select(F.log1p("price_million_vnd").alias("log_price"))
    provinces, sample, matrix = rows(tables["location_by_province"]), rows(tables["scatter_sample"]), rows(tables["correlation_matrix"])
    top = lambda name: [(r["province"], r[name]) for r in sorted(provinces, key=lambda r: (-(r[name] or 0), r["province"]))[:12]]
    high = fact.agg(F.percentile("price_million_vnd", F.lit(0.99))).first()[0] or 1.0
    kept = lambda column, most: rows(eda.box_summary(fact.filter(F.col(column).between(0, most)), column))
    return {
        "target_distributions.svg": figures.page(
            [
                figures.histogram("Price", rows(tables["price_histogram"]), "price_million_vnd"),
                figures.histogram("Log of price", bins(logged, "log_price"), "log(1 + price)"),
                figures.histogram("Unit price", bins(fact, "price_per_m2"), "price_per_m2")
            ],
            3
        ),
        "location_market_overview.svg": figures.page(
            [
                figures.bars("Provinces with most listings", top("listing_count"), "listings"),
                figures.bars("Provinces with the highest median unit price", top("median_price_per_m2"), "price per m2")
            ]
        ),
        "timeline_distribution.svg": figures.page(
            [figures.bars("Listings by age", [(r["time_bucket"], r["listing_count"]) for r in timeline], "listings")], 1
        ),
        "size_relationship_scatter.svg": figures.page(
            [
                figures.points("Area and price", sample, "area_m2", "price_million_vnd"),
                figures.points("Area and unit price", sample, "area_m2", "price_per_m2")
            ]
        ),
        "property_feature_analysis.svg": figures.page([
            figures.boxes("Price by bedrooms", kept("bedrooms", 10), "bedrooms", high),
            figures.boxes("Price by floors", kept("floors", 15), "floors", high),
            figures.histogram("Frontage", bins(fact, "frontage", 50), "frontage"),
            figures.histogram("Bathrooms", bins(fact, "bathrooms", 20), "bathrooms")]),
        "correlation_heatmap.svg": figures.page([figures.matrix("Correlations", matrix)], 1),
    }


def run_explore(spark: SparkSession, root: str, out: str, min_district_listings: int = 30, max_scatter_points: int = 10_000) -> dict:
    """All analyses; small tables as CSV, JSON and Markdown summaries. Only small results reach the driver."""
    house = Warehouse(spark, root)
    fact, mart = load_data(house)
    fact = fact.persist()
    rows = lambda df: [r.asDict() for r in df.collect()]
    matrix = eda.correlation_matrix(fact)
    tables = {
        "quality_missing_summary": eda.missing_summary(fact), "quality_numeric_ranges": eda.quality_ranges(fact),
        "location_by_province": eda.province_rank(fact),
        "location_by_district": eda.district_rank(fact, min_district_listings), "timeline_bucket_summary": eda.timeline_summary(fact),
        "size_outlier_candidates": eda.extreme_candidates(fact),
        "feature_bedrooms_stats": eda.effect(fact, "bedrooms", 10), "feature_floors_stats": eda.effect(fact, "floors", 15),
        "correlation_matrix": matrix,
        "mart_reconciliation": market.reconcile(mart, fact).filter("is_mismatch"), "price_histogram": eda.histogram(fact, "price_million_vnd", 60),
        "price_by_bedrooms": eda.box_summary(fact, "bedrooms"),
        "scatter_sample": eda.sample_points(fact, max_scatter_points).select("area_m2", "price_million_vnd", "price_per_m2"),
    }
    for name, df in tables.items():
        write_csv(df, f"{out}/tables/{name}")
    gaps = {r["column_name"]: r["missing_pct"] for r in rows(tables["quality_missing_summary"])}
    strong = {r["feature"]: r["corr"] for r in rows(eda.strong_predictors(matrix))}
    one = {
        "target": eda.target_distribution(fact), "duplicates": eda.duplicate_checks(fact), "correlations": eda.correlations(fact),
        "reconciliation": market.reconcile_counts(mart, fact)
    }
    got = {k: df.first().asDict() for k, df in one.items()}
    timeline = rows(tables["timeline_bucket_summary"])
    summary = {
        "Insights": report.insights(got["target"], gaps, got["correlations"], got["duplicates"], strong, got["reconciliation"], timeline),
        "Rows": {"fact": fact.count()}, **{k.capitalize(): v for k, v in got.items()},
        "Timeline": timeline, "Strong predictors": strong, "Multicollinear pairs": rows(eda.multicollinear_pairs(matrix)),
        "Features": report.recommend_features(gaps, strong)["feature_candidates"], "Strategy": report.modeling_strategy(gaps)}
    report.write(spark, f"{out}/figures", draw(fact, tables, timeline))
    report.save(spark, out, "eda_summary", "Exploratory summary", summary)
    fact.unpersist()
    return summary


def run_features(spark: SparkSession, root: str, out: str | None = None) -> dict:
    """Feature mart, catalog and summary."""
    house = Warehouse(spark, root)
    mart = house.replace(
        stamped(features.feature_mart(house.read("mart_avm_features").drop("refreshed_at"), distributed=True)), "mart_avm_features_final",
        FEATURE_MART
    )
    summary = eda.feature_summary(mart).first().asDict()
    if out:
        for name, df in catalog.tables(spark).items():
            write_csv(df, f"{out}/tables/{name}")
        report.save(
            spark, out, "feature_summary", "Feature engineering summary",
            {"Counts": summary, "Target": catalog.TARGET, "Encoding": catalog.ENCODING, "Leakage": catalog.LEAKAGE}
        )
    return summary


def load_final(house: Warehouse) -> DataFrame:
    return house.read("mart_avm_features_final").orderBy("listing_id")


def run_profile(spark: SparkSession, path: str, out: str) -> dict:
    found = profile.build_report(read_raw_text(spark, path), path)
    report.save(spark, out, "profile", "Raw profile", {k: v if isinstance(v, (dict, list)) else str(v) for k, v in found.items()})
    return found


def run_checks(spark: SparkSession, root: str) -> dict[str, list[dict]]:
    """Both validation packs over the warehouse's tables, and the last five runs."""
    house = Warehouse(spark, root)
    names = {
        "staging": "stg_listings_raw", "staging_raw_text": "stg_listings_raw_text", "fact": "fact_listings", "dim_location": "dim_location",
        "mart_market_analytics": "mart_market_analytics", "mart_avm_features": "mart_avm_features"
    }
    found = checks.phase1({k: house.read(t) for k, t in names.items()})
    if house.exists("mart_avm_features_final"):
        found |= {f"features_{k}": v for k, v in checks.phase3(house.read("mart_avm_features"), house.read("mart_avm_features_final")).items()}
    found["last_runs"] = quality.RunLog(house).latest().orderBy(F.desc("run_id")).limit(5)
    return {k: [r.asDict() for r in df.collect()] for k, df in found.items()}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="listingmart")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for flag, kind, default in options:
            p.add_argument(flag, type=kind, default=default)
        return p

    house = ("--warehouse", str, os.environ.get("LISTINGMART_WAREHOUSE", "warehouse"))
    limits = [(f"--{f.name.replace('_', '-')}", float, f.default) for f in fields(quality.Thresholds)]
    load = command("load", house, ("--csv-path", str, "listings.csv"), *limits)
    load.add_argument("--skip-marts", action="store_true")
    load.add_argument("--skip-quality-gate", action="store_true")
    command("explore", house, ("--output-dir", str, "reports/eda"), ("--min-district-listings", int, 30), ("--max-scatter-points", int, 10_000))
    command("features", house, ("--output-dir", str, "reports/features"))
    command("profile", ("--input-csv", str, "listings.csv"), ("--output-dir", str, "reports/profile"))
    command("check", house)
    a = parser.parse_args(argv)
    spark = build()
    if a.command == "load":
        chosen = quality.Thresholds(**{f.name: getattr(a, f.name) for f in fields(quality.Thresholds)})
        done = run_load(spark, read_raw_text(spark, a.csv_path), a.warehouse, chosen, a.skip_marts, a.skip_quality_gate)
        print("\n".join(f"{k}: {report.told(v)}" for k, v in done.items()))
    elif a.command == "explore":
        print("\n".join(run_explore(spark, a.warehouse, a.output_dir, a.min_district_listings, a.max_scatter_points)["Insights"]))
    elif a.command == "features":
        print(run_features(spark, a.warehouse, a.output_dir))
    elif a.command == "profile":
        print(run_profile(spark, a.input_csv, a.output_dir)["row_count"], "rows")
    else:
        for name, found in run_checks(spark, a.warehouse).items():
            print(name, found)
