"""Read-only analyses over the fact table. Each returns a small DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.buckets import USER, bucket, ordinal
from ..functions.text import strip
from ..operators.fact import dedupe_key
from ..operators.quantiles import exact_medians, exact_quantiles

#: Columns whose gaps are reported, columns with ranges, columns of the correlation matrix.
KEY_COLUMNS = ["price_million_vnd", "area_m2", "bedrooms", "bathrooms", "floors", "frontage", "province", "district"]
RANGE_COLUMNS = ["price_million_vnd", "area_m2", "bedrooms", "bathrooms", "floors", "frontage"]
CORR_COLUMNS = ["area_m2", "bedrooms", "bathrooms", "floors", "frontage", "price_million_vnd", "price_per_m2"]
PAIRS = {
    "corr_area_price": ("area_m2", "price_million_vnd"), "corr_area_ppm2": ("area_m2", "price_per_m2"),
    "corr_bedrooms_price": ("bedrooms", "price_million_vnd"),
    "corr_bathrooms_price": ("bathrooms", "price_million_vnd"), "corr_floors_price": ("floors", "price_million_vnd"),
    "corr_frontage_price": ("frontage", "price_million_vnd"),
    "corr_bedrooms_bathrooms": ("bedrooms", "bathrooms"), "corr_bedrooms_floors": ("bedrooms", "floors"),
    "corr_price_ppm2": ("price_million_vnd", "price_per_m2"),
}
MEDIANS = {"price_million_vnd": "median_price_million_vnd", "price_per_m2": "median_price_per_m2"}


def market_by(rows: DataFrame, key: str) -> DataFrame:
    """Count and both medians by a column of few values, so of large groups: no reducer holds a group's distinct values."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("listing_count"))
    medians = exact_medians(rows, [key], MEDIANS).withColumnRenamed(key, "_key")
    return counts.join(medians, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def long_form(row: DataFrame, names: Sequence[str], fields: Sequence[str], key: str) -> DataFrame:
    """A one-row frame of name__field columns as one row a name."""
    parts = F.array(*(F.struct(F.lit(n).alias(key), *(F.col(f"{n}__{f}").alias(f) for f in fields)) for n in names))
    return row.select(F.explode(parts).alias("x")).select("x.*")


def missing_summary(fact: DataFrame, columns: Sequence[str] = KEY_COLUMNS) -> DataFrame:
    """Missing count and percentage of each column, in one pass; blank texts count as missing."""
    texts = {f.name for f in fact.schema if f.dataType.simpleString() == "string"}
    gap = lambda c: F.col(c).isNull() | (strip(F.col(c)) == "") if c in texts else F.col(c).isNull()
    row = fact.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(gap(c)).alias(f"{c}__missing_count") for c in columns))
    row = row.withColumns(
        {f"{c}__missing_pct": F.round(F.coalesce(F.try_divide(100.0 * F.col(f"{c}__missing_count"), F.col("_n")), F.lit(0.0)), 4) for c in columns}
    )
    return long_form(row, columns, ["missing_count", "missing_pct"], "column_name").orderBy("column_name")


def numeric_ranges(fact: DataFrame, columns: Sequence[str] = RANGE_COLUMNS) -> DataFrame:
    aggs = [
        x for c in columns for x in (
            F.min(F.col(c).cast("double")).alias(f"{c}__min_value"), F.max(F.col(c).cast("double")).alias(f"{c}__max_value")
        )
    ]
    row = fact.agg(*aggs).crossJoin(exact_medians(fact, [], {c: f"{c}__median_value" for c in columns}))  # one row each
    return long_form(row, columns, ["min_value", "median_value", "max_value"], "metric").orderBy("metric")


def quality_ranges(fact: DataFrame, columns: Sequence[str] = RANGE_COLUMNS) -> DataFrame:
    aggs = [
        x for c in columns for x in (
            F.count(c).alias(f"{c}__count"), F.min(F.col(c).cast("double")).alias(f"{c}__min"),
            F.max(F.col(c).cast("double")).alias(f"{c}__max")
        )
    ]
    edges = exact_quantiles(fact, dict.fromkeys(columns, (0.5, 0.95, 0.99))).withColumnsRenamed({c: f"{c}__q" for c in columns})
    row = fact.agg(*aggs).crossJoin(edges).withColumns({f"{c}__{p}": F.get(f"{c}__q", F.lit(k)) for c in columns for k, p in enumerate(("p50", "p95", "p99"))})
    return long_form(row, columns, ["count", "min", "p50", "p95", "p99", "max"], "column")


def duplicate_checks(fact: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return fact.agg(
        (n - F.count_distinct("listing_id")).alias("duplicate_listing_id_rows"),
        (n - F.count_distinct(dedupe_key("detail_url", "listing_id"))).alias("duplicate_dedupe_key_rows")
    )


def skew_population(fact: DataFrame) -> DataFrame:
    p = "price_million_vnd"
    return fact.agg(
        F.count(p).alias("n"), F.avg(p).alias("mean_price"), F.stddev_pop(p).alias("std_price"), F.skewness(p).alias("skewness_price")
    ).crossJoin(exact_medians(fact, [], {p: "median_price"}))


def moments(fact: DataFrame, column, name: str) -> DataFrame:
    rows = fact.select(column.alias("x"))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias(f"mean_{name}"), F.stddev_pop("x").alias(f"std_{name}")
    ).crossJoin(exact_medians(rows, [], {"x": f"median_{name}"}))


def target_distribution(fact: DataFrame) -> DataFrame:
    """Bias-adjusted skewness of price, its log and the unit price; the log is advised if it lowers the skewness."""
    out = fact.agg(
        stats.skew_adjusted("price_million_vnd").alias("price_skewness"),
        stats.skew_adjusted(F.log1p("price_million_vnd")).alias("log_price_skewness"),
        stats.skew_adjusted("price_per_m2").alias("price_per_m2_skewness")
    )
    return out.withColumn("log_transform_recommended", F.col("log_price_skewness") < F.col("price_skewness"))


def province_rank(fact: DataFrame) -> DataFrame:
    return market_by(fact, "province").orderBy(F.desc_nulls_first("median_price_per_m2"), F.desc("listing_count"), "province")


def district_rank(fact: DataFrame, min_listings: int = 30) -> DataFrame:
    rows = fact.groupBy("province", "district").agg(
        F.count(F.lit(1)).alias("listing_count"), *(stats.median(c).alias(name) for c, name in MEDIANS.items())
    ).filter(F.col("listing_count") >= min_listings)
    return rows.orderBy(F.desc_nulls_first("median_price_per_m2"), F.desc("listing_count"), "province", "district")


def top_provinces(fact: DataFrame, by: str = "listing_count", k: int = 12) -> DataFrame:
    return province_rank(fact).orderBy(F.desc(by), "province").limit(k)


def timeline_summary(fact: DataFrame) -> DataFrame:
    return market_by(fact.withColumn("time_bucket", bucket(F.col("timeline_hours"), USER)), "time_bucket").orderBy(ordinal(F.col("time_bucket")))


def correlations(fact: DataFrame, pairs: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One row, one pass."""
    return fact.agg(*(stats.corr(a, b).alias(k) for k, (a, b) in (pairs or PAIRS).items()))


def correlation_matrix(fact: DataFrame, columns: Sequence[str] = CORR_COLUMNS) -> DataFrame:
    """variable_1, variable_2, corr of all pairs; each unordered pair is computed once, over rows where both are known."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = fact.agg(*(stats.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    cells = [
        F.struct(F.lit(x).alias("variable_1"), F.lit(y).alias("variable_2"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs) for x,
        y in dict.fromkeys(((a, b), (b, a)))
    ]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def strong_predictors(matrix: DataFrame, least: float = 0.2) -> DataFrame:
    rows = matrix.filter((F.col("variable_1") == "price_million_vnd") & (F.col("variable_2") != "price_million_vnd") & (F.abs("corr") >= least))
    return rows.select(F.col("variable_2").alias("feature"), "corr").orderBy(F.abs("corr").desc(), "feature")


def multicollinear_pairs(matrix: DataFrame, least: float = 0.7, columns: Sequence[str] = CORR_COLUMNS) -> DataFrame:
    order = F.array(*map(F.lit, columns))
    rows = matrix.filter(
        ~F.col("variable_1").isin("price_million_vnd", "price_per_m2") & ~F.col("variable_2").isin("price_million_vnd", "price_per_m2")
    )
    rows = rows.filter((F.array_position(order, F.col("variable_1")) < F.array_position(order, F.col("variable_2"))) & (F.abs("corr") >= least))
    return rows.select(F.col("variable_1").alias("feature_1"), F.col("variable_2").alias("feature_2"), "corr")


_CANDIDATE = ["listing_id", "province", "district", "area_m2", "price_million_vnd", "price_per_m2"]


def largest(fact: DataFrame, k: int = 50) -> DataFrame:
    return fact.select(*_CANDIDATE).orderBy(F.desc("area_m2"), F.desc("price_per_m2"), "listing_id").limit(k)


def extreme_candidates(fact: DataFrame, p: float = 0.995, k: int = 200) -> DataFrame:
    """Listings at or above the p-quantile of area or unit price, largest first."""
    edge = exact_quantiles(fact, {"area_m2": (p,), "price_per_m2": (p,)})
    edge = edge.select(F.get("area_m2", F.lit(0)).alias("_a"), F.get("price_per_m2", F.lit(0)).alias("_p"))
    rows = fact.select(*_CANDIDATE).crossJoin(F.broadcast(edge))  # one row
    return largest(rows.filter((F.col("area_m2") >= F.col("_a")) | (F.col("price_per_m2") >= F.col("_p"))), k)


def effect(fact: DataFrame, column: str, most: int | None = None, unknown: bool = False) -> DataFrame:
    """Count and medians by a count column; most: values outside 0..most are left out; unknown: nulls are a group."""
    keep = F.col(column).isNotNull() if most is None else F.col(column).between(0, most)
    rows = fact.filter(keep | F.col(column).isNull() if unknown else F.coalesce(keep, F.lit(False)))
    return market_by(rows, column).orderBy(column)


def missing_ratios(fact: DataFrame) -> DataFrame:
    gaps = ["area_m2", "bedrooms", "bathrooms", "floors", "frontage", "timeline_hours"]
    return fact.agg(
        F.count(F.lit(1)).alias("row_count"), *(F.round(F.avg(F.col(c).isNull().cast("int")), 4).alias(f"miss_{c}") for c in gaps),
        F.count_distinct("province").alias("n_province"), F.count_distinct("district").alias("n_district")
    )


def sample_points(fact: DataFrame, n: int = 10_000, seed: int = 42) -> DataFrame:
    """A repeatable sample: the n listings whose ids hash smallest."""
    return fact.orderBy(F.xxhash64("listing_id", F.lit(seed)), "listing_id").limit(n)


def histogram(fact: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins over the value range, the last one closed: bin, low, high, n."""
    edge = fact.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    rows = fact.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_x")).crossJoin(F.broadcast(edge))  # one row
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.coalesce(F.floor(F.try_divide(F.col("_x") - F.col("_lo"), width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return rows.withColumn("bin", at).groupBy("bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("n")).select(
        "bin", (F.col("_lo") + F.col("bin") * width).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("high"), "n"
    ).orderBy("bin")


def box_summary(fact: DataFrame, key: str, column: str = "price_million_vnd") -> DataFrame:
    """What a box plot by key draws: quartiles and whisker ends."""
    q = fact.groupBy(key).agg(
        stats.quantiles(column, (0.25, 0.5, 0.75)).alias("q"), F.min(column).alias("min"), F.max(column).alias("max"), F.count(column).alias("n")
    )
    return q.select(key, *(F.get("q", F.lit(k)).alias(p) for k, p in enumerate(("q1", "median", "q3"))), "min", "max", "n").orderBy(key)


def outlier_rate_by_province(avm: DataFrame, min_listings: int = 30, k: int = 10) -> DataFrame:
    rows = avm.groupBy("province").agg(
        F.count(F.lit(1)).alias("listing_count"), F.count_if(F.coalesce("is_outlier_any", F.lit(False))).alias("outlier_count")
    )
    rows = rows.withColumn("outlier_rate_pct", 100.0 * F.col("outlier_count") / F.col("listing_count")).filter(F.col("listing_count") >= min_listings)
    return rows.orderBy(F.desc("outlier_rate_pct"), "province").limit(k)


def avm_flag_counts(avm: DataFrame) -> DataFrame:
    filled = ("bedrooms", "bathrooms", "floors")
    return avm.agg(
        *(F.count_if(f"{c}_missing").alias(f"{c}_missing_rows") for c in filled),
        *(F.count_if(F.col(f"{c}_imputed").isNull()).alias(f"null_{c}_imputed") for c in filled),
        *(F.count_if(f"is_outlier_{x}").alias(f"outlier_{x}_rows") for x in ("price", "area", "price_per_m2", "any")),
        F.count_if("is_robust_train_candidate").alias("robust_train_candidate_rows"))


def feature_summary(features: DataFrame) -> DataFrame:
    """Ten filtered counts of the feature mart in one pass."""
    gaps = ("timeline", "frontage", "bedrooms", "bathrooms", "floors")
    flags = {
        "area_outlier_rows": "is_outlier_area", "price_outlier_rows": "is_outlier_price", "price_per_m2_outlier_rows": "is_outlier_price_per_m2",
        "robust_train_candidate_rows": "is_robust_train_candidate"
    }
    return features.agg(
        F.count(F.lit(1)).alias("row_count"), *(F.count_if(f"{g}_missing").alias(f"{g}_missing_rows") for g in gaps),
        *(F.count_if(c).alias(k) for k, c in flags.items())
    )
