"""The warehouse's queries over listings derived from the test tables, and the same in SQL.

Doubles whose last digits depend on the order of addition are rounded on both sides, after a nudge off exact ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import buckets, location, stats, text
from .operators import checks, encoders, quality
from .operators import fact as facts
from .operators.quantiles import exact_medians, exact_quantiles
from .operators.staging import build_staging, build_staging_strict
from .plans import avm, eda, features, market, profile
from .schemas import FACT as FACT_SCHEMA
from .sources.csvfile import raw_landing, read_copy, read_raw_text
from .sources.scratch import scratch_path
from .sources.tables import Warehouse
from .sources.testdata import STAGING_SQL, raw_text, staging

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


_stored: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, d: str, name: str, make: Query) -> DataFrame:
    """A warehouse table over the folder's data: written when the session first needs it, read by every later query."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _stored:
        path = scratch_path(spark, name)
        make(spark, d).write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def build_fact(spark: SparkSession, d: str) -> DataFrame:
    return facts.build_fact(staging(spark, d), check=False)


def build_avm(spark: SparkSession, d: str) -> DataFrame:
    return avm.avm_mart(fact(spark, d), dim(spark, d), distributed=True)


def build_features(spark: SparkSession, d: str) -> DataFrame:
    return features.feature_mart(avm_mart(spark, d), distributed=True)


def fact(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "fact", build_fact)


def prices(spark: SparkSession, d: str) -> DataFrame:
    """The fact's ids and fenced columns: of the fact where the session has it, else written alone, without the places,
    which cost more than all else in a fact."""
    columns = ("listing_id", *_FENCED)
    if (spark.sparkContext.applicationId, d, "fact") in _stored:
        return fact(spark, d).select(*columns)
    return stored(spark, d, "prices", lambda s, x: build_fact(s, x).select(*columns))


def dim(spark: SparkSession, d: str) -> DataFrame:
    return facts.dim_location(fact(spark, d))


def avm_mart(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "avm", build_avm)


def feature_mart(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "features", build_features)


def near(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + 1e-9, digits) for c in columns})


def near_sql(sql: str, *columns: str, digits: int = 4) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c} + 1e-9, {digits}) AS {c}' for c in columns)}) FROM ({sql})"


def add(name: str, sql: str | None = None, ctes: str = "") -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = (f"WITH {ctes} " if ctes else "") + sql
        return f

    return register


_TITLE = "array_to_string([upper(w[1]) || w[2:] for w in string_split(replace(lower({0}), '_', ' '), ' ')], ' ')"
STAGING = f"staging AS ({STAGING_SQL})"
_REST = ", ".join(
    f"{c} NULLS FIRST" for c in ("detail_url", "title", "location", "area_m2", "bedrooms", "bathrooms", "floors", "frontage", "price_million_vnd")
)
_KEY = "coalesce(nullif(trim(detail_url), ''), 'id:' || id)"
FACT = f"""{STAGING}, valid AS (SELECT * FROM staging WHERE id IS NOT NULL AND price_million_vnd > 0 AND area_m2 > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY timeline_hours NULLS LAST,
    (bedrooms IS NOT NULL)::INT + (bathrooms IS NOT NULL)::INT + (floors IS NOT NULL)::INT + (frontage IS NOT NULL)::INT DESC, id,
    {_REST}) AS n FROM valid),
fact AS (SELECT id AS listing_id, nullif(detail_url, '') AS detail_url, title, {_TITLE.format("split_part(location, ', ', 2)")} AS province,
    {_TITLE.format("split_part(location, ', ', 1)")} AS district,
    timeline_hours, area_m2, bedrooms, bathrooms, floors, frontage, price_million_vnd,
    price_million_vnd / area_m2 AS price_per_m2 FROM ranked WHERE n = 1)"""


def _bucket_sql(labels: tuple[str, ...]) -> str:
    edges = " ".join(f"WHEN timeline_hours < {e} THEN '{x}'" for e, x in zip(buckets.EDGES, labels, strict=False))
    return f"CASE WHEN timeline_hours IS NULL THEN 'unknown' {edges} ELSE '{labels[-1]}' END"


_MART, _USER = _bucket_sql(buckets.MART), _bucket_sql(buckets.USER)
_MEDIANS = "quantile_cont(price_million_vnd, 0.5) AS median_price_million_vnd, quantile_cont(price_per_m2, 0.5) AS median_price_per_m2"
MARKET = f"market AS (SELECT province, district, {_MART} AS time_bucket, {_MEDIANS}, count(*) AS listing_count FROM fact GROUP BY ALL)"
DIM = "dim AS (SELECT row_number() OVER (ORDER BY province, district)::INT AS location_id, province, district FROM (SELECT DISTINCT province, district FROM fact))"
_stat = lambda level: ", ".join(f"count({c}) AS {level}_{c}_count, quantile_disc({c}, 0.5)::INT AS {level}_median_{c}" for c in avm.IMPUTED)
_filled = lambda c: f"{c}, {c} IS NULL AS {c}_missing, coalesce({c}, CASE WHEN district_{c}_count >= 30 THEN district_median_{c} END, CASE WHEN province_{c}_count >= 30 THEN province_median_{c} END, global_median_{c}) AS {c}_imputed"
_out = lambda c: f"(f.{c} < {c}_q1 - 1.5 * ({c}_q3 - {c}_q1) OR f.{c} > {c}_q3 + 1.5 * ({c}_q3 - {c}_q1))"
_FENCED = ("price_million_vnd", "area_m2", "price_per_m2")
STATS = f"""ds AS (SELECT province, district, {_stat("district")}, quantile_cont(price_million_vnd, 0.5) AS district_median_price_million_vnd,
    quantile_cont(price_per_m2, 0.5) AS district_median_price_per_m2 FROM fact GROUP BY ALL),
ps AS (SELECT province, {_stat("province")} FROM fact GROUP BY ALL), gs AS (SELECT {_stat("global")} FROM fact),
ob AS (SELECT {", ".join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3" for c in _FENCED)} FROM fact)"""
AVM = f"""{FACT}, {DIM}, {STATS},
flagged AS (SELECT listing_id, location_id, f.province, f.district, timeline_hours, {_MART} AS time_bucket, area_m2,
    {", ".join(map(_filled, avm.IMPUTED))}, frontage, district_median_price_million_vnd, district_median_price_per_m2,
    {_out("price_million_vnd")} AS is_outlier_price, {_out("area_m2")} AS is_outlier_area, {_out("price_per_m2")} AS is_outlier_price_per_m2,
    price_million_vnd AS target_price_million_vnd, price_per_m2 AS target_price_per_m2
    FROM fact f CROSS JOIN gs CROSS JOIN ob LEFT JOIN ds ON ds.province = f.province AND ds.district = f.district LEFT JOIN ps ON ps.province = f.province LEFT JOIN dim ON dim.province = f.province AND dim.district = f.district),
avm AS (SELECT *, is_outlier_price OR is_outlier_area OR is_outlier_price_per_m2 AS is_outlier_any,
    NOT (is_outlier_price OR is_outlier_area OR is_outlier_price_per_m2) AS is_robust_train_candidate FROM flagged)"""
_ref = lambda level, keys: f"SELECT {keys}, count(*)::INT AS {level}_listing_count_ref, count(*) / (SELECT count(*) FROM avm)::DOUBLE AS {level}_frequency_ref, quantile_cont(target_price_million_vnd, 0.5) AS {level}_median_price_million_vnd_ref, quantile_cont(target_price_per_m2, 0.5) AS {level}_median_price_per_m2_ref FROM avm GROUP BY ALL"
FEATURES = f"""{AVM}, pr AS ({_ref("province", "province")}), dr AS ({_ref("district", "province, district")}),
q AS (SELECT quantile_cont(timeline_hours, 0.5) AS t50, quantile_cont(timeline_hours, 0.99) AS t99, quantile_cont(area_m2, 0.5) AS a50,
    quantile_cont(area_m2, 0.75) AS a75, quantile_cont(area_m2, 0.99) AS a99, quantile_cont(bedrooms_imputed, 0.99) AS b99,
    quantile_cont(bathrooms_imputed, 0.99) AS h99, quantile_cont(floors_imputed, 0.99) AS f99 FROM avm),
base AS (SELECT avm.*, pr.* EXCLUDE (province), dr.* EXCLUDE (province, district), q.*, coalesce(timeline_hours::DOUBLE, t50) AS hours,
    coalesce(timeline_hours, round_even(t50, 0)::INT) AS whole, coalesce(frontage, 0) > 0 AS front,
    bedrooms_imputed + bathrooms_imputed AS rooms
    FROM avm CROSS JOIN q LEFT JOIN pr ON pr.province = avm.province LEFT JOIN dr ON dr.province = avm.province AND dr.district = avm.district),
features AS (SELECT listing_id, location_id, province, district, province_listing_count_ref, district_listing_count_ref,
    province_frequency_ref, district_frequency_ref,
    province_median_price_million_vnd_ref, province_median_price_per_m2_ref, district_median_price_million_vnd_ref, district_median_price_per_m2_ref,
    district_median_price_million_vnd_ref / nullif(province_median_price_million_vnd_ref, 0) AS district_to_province_price_ratio_ref,
    district_median_price_per_m2_ref / nullif(province_median_price_per_m2_ref, 0) AS district_to_province_price_per_m2_ratio_ref,
    timeline_hours, timeline_hours IS NULL AS timeline_missing, whole AS timeline_hours_imputed, least(hours,
    t99) AS timeline_hours_capped_p99, hours / 24.0::DOUBLE AS timeline_days_imputed, ln(1 + hours) AS timeline_log_hours,
    {_USER} AS timeline_bucket,
    whole < 72 AS is_new_listing, whole > 720 AS is_stale_listing, area_m2, least(area_m2, a99) AS area_m2_capped_p99, ln(1 + area_m2) AS log_area_m2,
    bedrooms_imputed, bedrooms_missing, least(bedrooms_imputed::DOUBLE, b99) AS bedrooms_capped_p99, bathrooms_imputed, bathrooms_missing,
    least(bathrooms_imputed::DOUBLE, h99) AS bathrooms_capped_p99, floors_imputed, floors_missing, least(floors_imputed::DOUBLE,
    f99) AS floors_capped_p99,
    frontage AS frontage_raw, frontage IS NULL AS frontage_missing, front AS has_frontage, rooms AS total_rooms, area_m2 / greatest(rooms,
    1) AS area_per_room, bedrooms_imputed / nullif(area_m2, 0) AS bedroom_density, bathrooms_imputed / nullif(area_m2,
    0) AS bathroom_density,
    CASE WHEN front THEN ln(1 + area_m2) ELSE 0 END AS has_frontage_x_log_area, area_m2 >= a75 AS is_large_property,
    floors_imputed >= 2 AS is_multi_floor,
    is_outlier_area, is_outlier_price, is_outlier_price_per_m2, is_outlier_any, is_robust_train_candidate, target_price_million_vnd,
    ln(1 + target_price_million_vnd) AS target_log_price_million_vnd, target_price_per_m2,
    ln(1 + target_price_per_m2) AS target_log_price_per_m2, 'phase3_v1' AS feature_version FROM base)"""
_FEATURE_DOUBLES = [
    "province_frequency_ref", "district_frequency_ref", "district_to_province_price_ratio_ref", "district_to_province_price_per_m2_ratio_ref",
    "timeline_hours_capped_p99", "timeline_days_imputed", "timeline_log_hours", "area_m2_capped_p99",
    "log_area_m2", "bedrooms_capped_p99", "bathrooms_capped_p99", "floors_capped_p99", "area_per_room", "bedroom_density", "bathroom_density",
    "has_frontage_x_log_area", "target_log_price_million_vnd", "target_log_price_per_m2"]


# --- marts and core operators; the first is the flagship
@add("market_mart", "SELECT * FROM market", f"{FACT}, {MARKET}")
def _(spark, d):
    return market.market_mart(fact(spark, d))


@add(
    "staging_cast",
    "SELECT id, detail_url, title, location, timeline_hours, area_m2, bedrooms, bathrooms, floors, frontage, price_million_vnd FROM staging", STAGING
)
def _(spark, d):
    return build_staging(raw_text(spark, d))


@add("frontage_coerce", "SELECT frontage, count(*) AS n FROM staging GROUP BY frontage", STAGING)
def _(spark, d):
    return raw_text(spark, d).select(text.coerce_frontage(F.col("frontage")).alias("frontage")).groupBy("frontage").agg(F.count(F.lit(1)).alias("n"))


@add(
    "location_normalize",
    f"SELECT DISTINCT location, {_TITLE.format('split_part(location, chr(44) || chr(32), 2)')} AS province, "
    f"{_TITLE.format('split_part(location, chr(44) || chr(32), 1)')} AS district FROM staging",
    STAGING
)
def _(spark, d):
    province, district = location.extract_location(F.col("location"))
    return staging(spark, d).select("location").distinct().select("location", province.alias("province"), district.alias("district"))


@add(
    "accent_strip",
    "SELECT doc_id, strip_accents(replace(replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 'đ', 'd'), 'Đ', 'D')) AS plain FROM documents"
)
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.remove_accents(F.col("text")).alias("plain"))


@add("title_case", "SELECT n_name, upper(n_name[1]) || lower(n_name[2:]) AS title FROM nation")
def _(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet").select("n_name", text.title(F.col("n_name")).alias("title"))


@add("valid_filter", "SELECT id, price_million_vnd, area_m2 FROM valid", FACT)
def _(spark, d):
    return facts.valid(staging(spark, d)).select("id", "price_million_vnd", "area_m2")


@add("dedupe_latest", "SELECT id, title, timeline_hours, price_million_vnd FROM ranked WHERE n = 1", FACT)
def _(spark, d):
    return facts.dedupe_latest(facts.valid(staging(spark, d))).select("id", "title", "timeline_hours", "price_million_vnd")


@add("dup_id_conflicts", "SELECT id, count(*) AS n_rows FROM staging GROUP BY id HAVING count(*) > 1", STAGING)
def _(spark, d):
    return facts.conflicting_ids(staging(spark, d))


@add("fact_listings", "SELECT * FROM fact", FACT)
def _(spark, d):
    return build_fact(spark, d)


@add("dim_location", "SELECT * FROM dim", f"{FACT}, {DIM}")
def _(spark, d):
    return dim(spark, d)


for _name, _labels, _sql in (("bucket_mart", buckets.MART, _MART), ("bucket_user", buckets.USER, _USER)):

    @add(_name, f"SELECT {_sql} AS time_bucket, count(*) AS n FROM staging GROUP BY ALL", STAGING)
    def _(spark, d, labels=_labels):
        return staging(spark, d).groupBy(buckets.bucket(F.col("timeline_hours"), labels).alias("time_bucket")).agg(F.count(F.lit(1)).alias("n"))


@add("district_stats_cont_disc", "SELECT * FROM ds", f"{FACT}, {STATS}")
def _(spark, d):
    return avm.observed_stats(fact(spark, d), "district", ["province", "district"], medians=True)


@add(
    "global_quantiles",
    near_sql(
        "SELECT " + ", ".join(
            f"quantile_cont({c}, {p}) AS {c}_p{round(p * 1000)}" for c in _FENCED for p in (0.25, 0.5, 0.75, 0.95, 0.99, 0.995)
        ) + " FROM fact",
        *(f"{c}_p{p}" for c in _FENCED for p in (250, 500, 750, 950, 990, 995))
    ),
    FACT
)
def _(spark, d):
    at = (0.25, 0.5, 0.75, 0.95, 0.99, 0.995)
    row = exact_quantiles(prices(spark, d), dict.fromkeys(_FENCED, at))
    names = {f"{c}_p{round(p * 1000)}": F.get(c, F.lit(k)) for c in _FENCED for k, p in enumerate(at)}
    return near(row.select(*(v.alias(k) for k, v in names.items())), *names)


@add("global_quantiles_distributed", SQL["global_quantiles"])
def _(spark, d):
    at = (0.25, 0.5, 0.75, 0.95, 0.99, 0.995)
    row = exact_quantiles(fact(spark, d), dict.fromkeys(_FENCED, at))
    names = {f"{c}_p{round(p * 1000)}": F.get(c, F.lit(k)) for c in _FENCED for k, p in enumerate(at)}
    return near(row.select(*(v.alias(k) for k, v in names.items())), *names)


_BOUND = {"price": "price_million_vnd", "area": "area_m2", "price_per_m2": "price_per_m2"}
_BOUNDS = [f"{n}_{x}" for n in _BOUND for x in ("q1", "q3", "low", "high")]


@add(
    "iqr_bounds",
    near_sql(
        "SELECT " + ", ".join(
            f"{c}_q1 AS {n}_q1, {c}_q3 AS {n}_q3, {c}_q1 - 1.5 * ({c}_q3 - {c}_q1) AS {n}_low, {c}_q3 + 1.5 * ({c}_q3 - {c}_q1) AS {n}_high" for n,
            c in _BOUND.items()
        ) + " FROM ob",
        *_BOUNDS
    ),
    f"{FACT}, {STATS}"
)
def _(spark, d):
    return near(avm.iqr_bounds(fact(spark, d)), *_BOUNDS)


@add(
    "iqr_flags", "SELECT listing_id, is_outlier_price, is_outlier_area, is_outlier_price_per_m2, is_outlier_any, is_robust_train_candidate FROM avm",
    AVM
)
def _(spark, d):
    f = prices(spark, d)
    rows = avm.flag_outliers(f.crossJoin(F.broadcast(avm.bounds(f, distributed=True))))  # one row
    return rows.select("listing_id", "is_outlier_price", "is_outlier_area", "is_outlier_price_per_m2", "is_outlier_any", "is_robust_train_candidate")


@add(
    "impute_three_level",
    "SELECT listing_id, bedrooms_imputed, bathrooms_imputed, floors_imputed, bedrooms_missing, bathrooms_missing, floors_missing FROM avm", AVM
)
def _(spark, d):
    return avm_mart(spark, d).select("listing_id", *(f"{c}_imputed" for c in avm.IMPUTED), *(f"{c}_missing" for c in avm.IMPUTED))


@add("avm_mart", "SELECT * FROM avm", AVM)
def _(spark, d):
    return build_avm(spark, d)


for _level, _keys in (("province", ["province"]), ("district", ["province", "district"])):

    @add(
        f"{_level}_refs",
        near_sql(
            f"SELECT * REPLACE ({_level}_listing_count_ref::BIGINT AS {_level}_listing_count_ref) FROM {_level[0]}r", f"{_level}_frequency_ref",
            digits=8
        ),
        FEATURES
    )
    def _(spark, d, level=_level, keys=_keys):
        rows = avm_mart(spark, d)
        return near(features.refs(rows, level, keys, rows.agg(F.count(F.lit(1)).alias("_total"))), f"{level}_frequency_ref", digits=8)


_QUANTILES = ["timeline_p50", "timeline_p99", "area_p50", "area_p75", "area_p99", "bedrooms_p99", "bathrooms_p99", "floors_p99"]


@add(
    "feature_quantiles",
    near_sql(
        "SELECT " + ", ".join(
            f"{a} AS {b}" for a, b in zip(("t50", "t99", "a50", "a75", "a99", "b99", "h99", "f99"), _QUANTILES, strict=True)
        ) + " FROM q",
        *_QUANTILES
    ),
    FEATURES
)
def _(spark, d):
    return near(features.feature_quantiles(avm_mart(spark, d)), *_QUANTILES)


@add("feature_mart", near_sql("SELECT * FROM features", *_FEATURE_DOUBLES, digits=6), FEATURES)
def _(spark, d):
    return near(build_features(spark, d), *_FEATURE_DOUBLES, digits=6)


# --- exploratory pack
@add("fact_row_count", "SELECT count(*) AS fact_row_count FROM fact", FACT)
def _(spark, d):
    return fact(spark, d).agg(F.count(F.lit(1)).alias("fact_row_count"))


_gap = lambda c: f"{c} IS NULL OR trim({c}) = ''" if c in ("province", "district") else f"{c} IS NULL"


@add(
    "missing_summary",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({_gap(c)}) AS missing_count, round(100.0::DOUBLE * count(*) FILTER ({_gap(c)}) / "
        "count(*), 4) AS missing_pct FROM fact" for c in eda.KEY_COLUMNS
    ),
    FACT
)
def _(spark, d):
    return eda.missing_summary(fact(spark, d))


@add(
    "numeric_ranges",
    " UNION ALL ".join(
        f"SELECT '{c}' AS metric, min({c})::DOUBLE AS min_value, quantile_cont({c}, 0.5)::DOUBLE AS median_value, max({c})::DOUBLE AS "
        "max_value FROM fact" for c in eda.RANGE_COLUMNS
    ),
    FACT
)
def _(spark, d):
    return eda.numeric_ranges(fact(spark, d))


@add(
    "quality_ranges",
    near_sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", min({c})::DOUBLE AS \"min\", quantile_cont({c}::DOUBLE, 0.5) AS p50, "
            f"quantile_cont({c}::DOUBLE, 0.95) AS p95, quantile_cont({c}::DOUBLE, 0.99) AS p99, max({c})::DOUBLE AS \"max\" FROM fact" for c in eda.RANGE_COLUMNS
        ),
        "p50", "p95", "p99"
    ),
    FACT
)
def _(spark, d):
    return near(eda.quality_ranges(fact(spark, d)), "p50", "p95", "p99")


@add(
    "dup_checks",
    "SELECT count(*) - count(DISTINCT listing_id) AS duplicate_listing_id_rows, count(*) - count(DISTINCT coalesce(nullif(trim(detail_url), "
    "''), 'id:' || listing_id)) AS duplicate_dedupe_key_rows FROM fact",
    FACT
)
def _(spark, d):
    return eda.duplicate_checks(fact(spark, d))


@add(
    "skew_pop",
    near_sql(
        "WITH s AS (SELECT avg(price_million_vnd) AS m, stddev_pop(price_million_vnd) AS sd FROM fact) SELECT count(*) AS n, any_value(m) AS "
        "mean_price, quantile_cont(price_million_vnd, 0.5) AS median_price, any_value(sd) AS std_price, avg(pow(price_million_vnd - m, 3)) / "
        "pow(any_value(sd), 3) AS skewness_price FROM fact CROSS JOIN s",
        "mean_price", "std_price", "skewness_price"
    ),
    FACT
)
def _(spark, d):
    return near(eda.skew_population(fact(spark, d)), "mean_price", "std_price", "skewness_price")


@add(
    "skew_adjusted",
    near_sql(
        "SELECT skewness(price_million_vnd) AS price_skewness, skewness(ln(1 + price_million_vnd)) AS log_price_skewness, "
        "skewness(price_per_m2) AS price_per_m2_skewness, skewness(ln(1 + price_million_vnd)) < skewness(price_million_vnd) AS "
        "log_transform_recommended FROM fact",
        "price_skewness", "log_price_skewness", "price_per_m2_skewness"
    ),
    FACT
)
def _(spark, d):
    return near(eda.target_distribution(fact(spark, d)), "price_skewness", "log_price_skewness", "price_per_m2_skewness")


@add(
    "log_price_stats",
    near_sql(
        "SELECT count(*) AS n, avg(ln(1 + price_million_vnd)) AS mean_log_price, quantile_cont(ln(1 + price_million_vnd), 0.5) AS "
        "median_log_price, stddev_pop(ln(1 + price_million_vnd)) AS std_log_price FROM fact",
        "mean_log_price", "median_log_price", "std_log_price"
    ),
    FACT
)
def _(spark, d):
    return near(eda.moments(fact(spark, d), F.log1p("price_million_vnd"), "log_price"), "mean_log_price", "median_log_price", "std_log_price")


@add(
    "ppm2_stats",
    near_sql(
        "SELECT count(*) AS n, avg(price_per_m2) AS mean_price_per_m2, quantile_cont(price_per_m2, 0.5) AS median_price_per_m2, "
        "stddev_pop(price_per_m2) AS std_price_per_m2 FROM fact",
        "mean_price_per_m2", "std_price_per_m2"
    ),
    FACT
)
def _(spark, d):
    return near(eda.moments(fact(spark, d), F.col("price_per_m2"), "price_per_m2"), "mean_price_per_m2", "std_price_per_m2")


@add("province_rank", f"SELECT province, count(*) AS listing_count, {_MEDIANS} FROM fact GROUP BY province", FACT)
def _(spark, d):
    return eda.province_rank(fact(spark, d))


@add(
    "top_provinces",
    f"SELECT province, count(*) AS listing_count, {_MEDIANS} FROM fact GROUP BY province ORDER BY listing_count DESC, province LIMIT 12", FACT
)
def _(spark, d):
    return eda.top_provinces(fact(spark, d))


@add("province_medians_distributed", f"SELECT province, {_MEDIANS} FROM fact GROUP BY province", FACT)
def _(spark, d):
    return exact_medians(fact(spark, d), ["province"], {c: f"median_{c}" for c in ("price_million_vnd", "price_per_m2")})


@add(
    "district_rank_having",
    f"SELECT province, district, count(*) AS listing_count, {_MEDIANS} FROM fact GROUP BY province, district HAVING count(*) >= 30", FACT
)
def _(spark, d):
    return eda.district_rank(fact(spark, d))


@add(
    "corr_pairs", near_sql("SELECT " + ", ".join(f"corr({a}, {b}) AS {k}" for k, (a, b) in eda.PAIRS.items()) + " FROM fact", *eda.PAIRS, digits=6),
    FACT
)
def _(spark, d):
    return near(eda.correlations(fact(spark, d)), *eda.PAIRS, digits=6)


_MATRIX = " UNION ALL ".join(
    f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, corr({a}, {b}) AS corr FROM fact" for a in eda.CORR_COLUMNS for b in eda.CORR_COLUMNS
)


@add("corr_matrix_long", near_sql(_MATRIX, "corr", digits=6), FACT)
def _(spark, d):
    return near(eda.correlation_matrix(fact(spark, d)), "corr", digits=6)


@add(
    "strong_predictors",
    near_sql(
        f"SELECT variable_2 AS feature, corr FROM ({_MATRIX}) WHERE variable_1 = 'price_million_vnd' AND variable_2 <> 'price_million_vnd' AND "
        "abs(corr) >= 0.2",
        "corr", digits=6
    ),
    FACT
)
def _(spark, d):
    return near(eda.strong_predictors(eda.correlation_matrix(fact(spark, d))), "corr", digits=6)


_ORDER = "[" + ", ".join(f"'{c}'" for c in eda.CORR_COLUMNS) + "]"


@add(
    "multicollinear_pairs",
    near_sql(
        f"SELECT variable_1 AS feature_1, variable_2 AS feature_2, corr FROM ({_MATRIX}) WHERE variable_1 NOT LIKE 'price%' AND variable_2 NOT "
        f"LIKE 'price%' AND list_position({_ORDER}, variable_1) < list_position({_ORDER}, variable_2) AND abs(corr) >= 0.7",
        "corr", digits=6
    ),
    FACT
)
def _(spark, d):
    return near(eda.multicollinear_pairs(eda.correlation_matrix(fact(spark, d))), "corr", digits=6)


_CAND = "listing_id, province, district, area_m2, price_million_vnd, price_per_m2"


@add("outlier_top50", f"SELECT {_CAND} FROM fact ORDER BY area_m2 DESC, price_per_m2 DESC, listing_id LIMIT 50", FACT)
def _(spark, d):
    return eda.largest(fact(spark, d))


@add(
    "p995_candidates",
    f"SELECT {_CAND} FROM fact CROSS JOIN (SELECT quantile_cont(area_m2, 0.995) AS a, quantile_cont(price_per_m2, 0.995) AS p FROM fact) WHERE "
    "area_m2 >= a OR price_per_m2 >= p ORDER BY area_m2 DESC, price_per_m2 DESC, listing_id LIMIT 200",
    FACT
)
def _(spark, d):
    return eda.extreme_candidates(fact(spark, d))


for _column, _most in (("bedrooms", 10), ("floors", 15)):
    _one = _column[:-1]

    @add(f"{_one}_effect", f"SELECT {_column}, count(*) AS listing_count, {_MEDIANS} FROM fact WHERE {_column} IS NOT NULL GROUP BY {_column}", FACT)
    def _(spark, d, column=_column):
        return eda.effect(fact(spark, d), column)

    @add(
        f"{_one}_effect_clamped",
        f"SELECT {_column}, count(*) AS listing_count, {_MEDIANS} FROM fact WHERE {_column} BETWEEN 0 AND {_most} GROUP BY {_column}", FACT
    )
    def _(spark, d, column=_column, most=_most):
        return eda.effect(fact(spark, d), column, most)


@add("timeline_summary", f"SELECT {_USER} AS time_bucket, count(*) AS listing_count, {_MEDIANS} FROM fact GROUP BY ALL", FACT)
def _(spark, d):
    return eda.timeline_summary(fact(spark, d))


@add("mart_reconcile_full_outer", """SELECT count(*) FILTER (m.province IS NULL OR f.province IS NULL OR coalesce(m.listing_count,
    -1) <> coalesce(f.listing_count, -1) OR abs(coalesce(m.median_price_million_vnd, -1) - coalesce(f.median_price_million_vnd, -1)) > 1e-9
    OR abs(coalesce(m.median_price_per_m2, -1) - coalesce(f.median_price_per_m2, -1)) > 1e-9) AS mismatch_group_count,
    count(*) AS compared_group_count
    FROM (SELECT * REPLACE (CASE WHEN listing_count % 50 = 7 THEN listing_count + 1 ELSE listing_count END AS listing_count) FROM market WHERE time_bucket <> 'unknown') m FULL JOIN market f ON m.province = f.province AND m.district = f.district AND m.time_bucket = f.time_bucket""", f"{FACT}, {MARKET}")
def _(spark, d):
    """A mart with changed and missing groups, so that mismatches of both kinds are counted."""
    f = fact(spark, d)
    n = F.col("listing_count")
    mart = market.market_mart(f).filter("time_bucket <> 'unknown'").withColumn("listing_count", F.when(n % 50 == 7, n + 1).otherwise(n))
    return market.reconcile_counts(mart, f)


@add(
    "missing_ratios",
    "SELECT count(*) AS row_count, " + ", ".join(
        f"round(avg(({c} IS NULL)::INT), 4) AS miss_{c}" for c in ("area_m2", "bedrooms", "bathrooms", "floors", "frontage", "timeline_hours")
    ) + ", count(DISTINCT province) AS n_province, count(DISTINCT district) AS n_district FROM fact",
    FACT
)
def _(spark, d):
    return eda.missing_ratios(fact(spark, d))


_COUNT = lambda test, name: f"count(*) FILTER ({test}) AS {name}"
_FLAGS = {"price": "outlier_price_rows", "area": "outlier_area_rows", "price_per_m2": "outlier_price_per_m2_rows", "any": "outlier_any_rows"}


@add(
    "avm_flag_counts",
    "SELECT " + ", ".join(
        [
            *(_COUNT(f"{c}_missing", f"{c}_missing_rows") for c in avm.IMPUTED),
            *(_COUNT(f"{c}_imputed IS NULL", f"null_{c}_imputed") for c in avm.IMPUTED), *(_COUNT(f"is_outlier_{k}", v) for k, v in _FLAGS.items()),
            _COUNT("is_robust_train_candidate", "robust_train_candidate_rows")
        ]
    ) + " FROM avm",
    AVM
)
def _(spark, d):
    return eda.avm_flag_counts(avm_mart(spark, d))


@add(
    "outlier_rate_by_province",
    near_sql(
        "SELECT province, count(*) AS listing_count, count(*) FILTER (is_outlier_any) AS outlier_count, 100.0::DOUBLE * count(*) FILTER "
        "(is_outlier_any) / count(*) AS outlier_rate_pct FROM avm GROUP BY province HAVING count(*) >= 30 ORDER BY outlier_rate_pct DESC, "
        "province LIMIT 10",
        "outlier_rate_pct"
    ),
    AVM
)
def _(spark, d):
    return near(eda.outlier_rate_by_province(avm_mart(spark, d)), "outlier_rate_pct")


@add(
    "histogram_price",
    near_sql(
        "WITH e AS (SELECT min(price_million_vnd) AS lo, max(price_million_vnd) AS hi FROM fact), b AS (SELECT least(floor((price_million_vnd "
        "- lo) / ((hi - lo) / 60)), 59)::INT AS bin, lo, hi FROM fact CROSS JOIN e) SELECT bin, lo + bin * ((hi - lo) / 60) AS low, lo + (bin "
        "+ 1) * ((hi - lo) / 60) AS high, count(*) AS n FROM b GROUP BY bin, lo, hi",
        "low", "high"
    ),
    FACT
)
def _(spark, d):
    return near(eda.histogram(fact(spark, d), "price_million_vnd", 60), "low", "high")


@add(
    "box_by_bedrooms",
    near_sql(
        "SELECT bedrooms, quantile_cont(price_million_vnd, 0.25) AS q1, quantile_cont(price_million_vnd, 0.5) AS median, "
        "quantile_cont(price_million_vnd, 0.75) AS q3, min(price_million_vnd) AS \"min\", max(price_million_vnd) AS \"max\", "
        "count(price_million_vnd) AS n FROM fact GROUP BY bedrooms",
        "q1", "median", "q3"
    ),
    FACT
)
def _(spark, d):
    return near(eda.box_summary(fact(spark, d), "bedrooms"), "q1", "median", "q3")


@add(
    "effect_range_or_null",
    f"SELECT bedrooms, count(*) AS listing_count, {_MEDIANS} FROM fact WHERE bedrooms IS NULL OR bedrooms BETWEEN 0 AND 5 GROUP BY bedrooms", FACT
)
def _(spark, d):
    return eda.effect(fact(spark, d), "bedrooms", 5, unknown=True)


@add("sample_size", "SELECT least(count(*), 1000) AS n FROM fact", FACT)
def _(spark, d):
    return eda.sample_points(fact(spark, d), 1000).agg(F.count(F.lit(1)).alias("n"))


# --- readers, sinks, gate
def raw_file(spark: SparkSession, d: str) -> str:
    """The raw rows as a CSV file with a header."""
    key = (spark.sparkContext.applicationId, d, "raw")
    if key not in _stored:
        path = scratch_path(spark, "raw")
        keep = {"nullValue": "", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
        raw_text(spark, d).write.options(header=True, escape='"', **keep).csv(path)
        _stored[key] = path
    return _stored[key]


_STAGED = "SELECT id, nullif(detail_url, '') AS detail_url, title, location, timeline_hours, area_m2, bedrooms, bathrooms, floors, frontage, price_million_vnd FROM staging"


@add("csv_load", _STAGED, STAGING)
def _(spark, d):
    return build_staging(raw_landing(read_raw_text(spark, raw_file(spark, d))))


@add("strict_copy", _STAGED, STAGING)
def _(spark, d):
    return build_staging_strict(read_copy(spark, raw_file(spark, d)))


@add("table_replace", "SELECT * FROM fact WHERE bedrooms IS NOT NULL", FACT)
def _(spark, d):
    """Writes a table, then replaces it by some of its own rows."""
    house = Warehouse(spark, scratch_path(spark, "house"))
    rows = house.replace(fact(spark, d), "fact_listings", FACT_SCHEMA)
    return house.replace(rows.filter("bedrooms IS NOT NULL"), "fact_listings", FACT_SCHEMA)


_DAYS = "SELECT strftime(d, '%Y%m%d')::INT AS date_id, d::DATE AS full_date, year(d)::INT AS year, quarter(d)::INT AS quarter, month(d)::INT AS month, week(d)::INT AS week FROM (SELECT unnest(generate_series(DATE '2021-01-01', DATE '2021-03-10', INTERVAL 1 DAY)) AS d)"


@add("add_missing_dates", _DAYS)
def _(spark, d):
    house = Warehouse(spark, scratch_path(spark, "house"))
    house.append(facts.dim_time("2021-01-01", "2021-02-10", spark), "dim_time")
    more = facts.dim_time("2021-02-01", "2021-03-10", spark)
    house.append(facts.add_missing(house.read("dim_time"), more, "date_id"), "dim_time")
    return house.read("dim_time")


@add(
    "spaces_normalize",
    "SELECT part.p_partkey, trim(regexp_replace(regexp_replace(concat(' ', p_type, './ ', p_brand, '-', p_name, chr(9)), '[._\\-/]', ' ', "
    "'g'), '\\s+', ' ', 'g')) AS plain FROM part"
)
def _(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet")
    return rows.select(
        "p_partkey", text.normalize_spaces(F.concat(F.lit(" "), "p_type", F.lit("./ "), "p_brand", F.lit("-"), "p_name", F.lit("\t"))).alias("plain")
    )


#: location, province, district.
_PLACES = [
    ("Q 12, TP HCM", "Ho Chi Minh", "Quan 12"), ("Đống Đa, Hà Nội", "Ha Noi", "Dong Da"),
    ("Huyện Củ Chi, Thành phố Hồ Chí Minh", "Ho Chi Minh", "Huyen Cu Chi"), ("Quận 1a, HN", "Ha Noi", "1A"),
    ("A, B, C", "C", "B"), ("Hà Nội", "Ha Noi", "Unknown"), ("", "Unknown", "Unknown"), (" , ", "Unknown", "Unknown"),
    ("Tx Sơn_Tây, tỉnh Quảng-Ninh", "Quang Ninh", "Son Tay"),
]


@add(
    "location_cases",
    "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in _PLACES) + ") AS t(location, province, district)"
)
def _(spark, d):
    rows = spark.createDataFrame([(r[0],) for r in _PLACES], "location string")
    province, district = location.extract_location(F.col("location"))
    return rows.select("location", location.known(province).alias("province"), location.known(district).alias("district"))


_CAPITAL = "array_to_string([upper(w[1]) || w[2:] for w in string_split(lower(split_part(location, ', ', {0})), ' ')], ' ')"


@add(
    "legacy_locations",
    f"SELECT DISTINCT location, {_CAPITAL.format(2)} AS province, {_CAPITAL.format(1)} AS district FROM staging", STAGING
)
def _(spark, d):
    province, district = location.legacy_places(F.col("location"))
    return staging(spark, d).select("location").distinct().select("location", province.alias("province"), district.alias("district"))


_LIMITS = quality.Thresholds(max_null_area_ratio=0.01, max_invalid_price_ratio=0.0, max_duplicate_detail_url_ratio=1.0, min_fact_row_ratio=0.999)


@add("gate_violations", f"""SELECT unnest([printf('null_area_ratio=%.4f > 0.0100', count(*) FILTER (area_m2 IS NULL) / count(*)::DOUBLE),
    printf('fact_row_ratio=%.4f < 0.9990', (SELECT count(*) FROM fact) / count(*)::DOUBLE)]) AS violation FROM staging""", FACT)
def _(spark, d):
    found = quality.metrics(staging(spark, d), fact(spark, d))
    return spark.createDataFrame([(v,) for v in quality.violations(found, _LIMITS)], "violation string")


@add("finite_values", "SELECT listing_id, price_million_vnd / 100 > log10(1.7976931348623157e308::DOUBLE) AS is_unknown FROM fact", FACT)
def _(spark, d):
    """Powers beyond the largest double are infinite, and read as unknown."""
    power = F.pow(F.lit(10.0), F.col("price_million_vnd") / 100)
    return fact(spark, d).select("listing_id", stats.finite(power).isNull().alias("is_unknown"))


# --- validation packs
@add(
    "check_invalid_values",
    "SELECT " + ", ".join(
        _COUNT(f"{c} <= 0 OR {c} IS NULL", f"invalid_{n}_rows") for n,
        c in (("price", "price_million_vnd"), ("area", "area_m2"), ("price_per_m2", "price_per_m2"))
    ) + " FROM fact",
    FACT
)
def _(spark, d):
    return checks.invalid_values(fact(spark, d))


@add(
    "check_blank_locations",
    "SELECT count(*) FILTER (province IS NULL OR province = '') AS null_or_empty_province, count(*) FILTER (district IS NULL OR district = "
    "'') AS null_or_empty_district FROM fact",
    FACT
)
def _(spark, d):
    return checks.blank_locations(fact(spark, d))


@add(
    "price_per_m2_check", "SELECT count(*) AS mismatched_rows FROM fact WHERE abs(price_per_m2 - price_million_vnd / nullif(area_m2, 0)) > 0.0001",
    FACT
)
def _(spark, d):
    return checks.price_per_m2_mismatches(fact(spark, d))


@add("referential_check", "SELECT count(*) FILTER (location_id IS NULL) AS avm_rows_without_location_id FROM avm", AVM)
def _(spark, d):
    return checks.missing_location_ids(avm_mart(spark, d))


_FLAGGED = [f"{c}_missing" for c in avm.IMPUTED] + [f"{c}_imputed" for c in avm.IMPUTED] + [
    "is_outlier_price", "is_outlier_area", "is_outlier_price_per_m2", "is_outlier_any", "is_robust_train_candidate"
]


@add(
    "check_flags",
    "SELECT " + ", ".join(
        [
            *(_COUNT(f"{c} IS NULL", f"null_{c}") for c in _FLAGGED), _COUNT("is_outlier_any", "flagged_outlier_rows"),
            _COUNT("is_robust_train_candidate", "robust_train_candidate_rows")
        ]
    ) + " FROM avm",
    AVM
)
def _(spark, d):
    return checks.flag_completeness(avm_mart(spark, d))


@add(
    "uncovered_missing",
    "SELECT " + ", ".join(_COUNT(f"{c} IS NULL AND {c}_imputed IS NULL", f"uncovered_{c}_missing") for c in avm.IMPUTED) + " FROM avm", AVM
)
def _(spark, d):
    return checks.uncovered_missing(avm_mart(spark, d))


@add(
    "check_row_counts",
    " UNION ALL ".join(
        f"SELECT '{n}_count' AS check_name, count(*)::VARCHAR AS check_value FROM {t}" for n,
        t in (
            ("staging", "staging"), ("staging_raw_text", "staging"), ("fact", "fact"), ("dim_location", "dim"), ("mart_market_analytics", "market"),
            ("mart_avm_features", "avm")
        )
    ),
    f"{AVM}, {MARKET}"
)
def _(spark, d):
    f = fact(spark, d)
    return checks.row_counts(
        {
            "staging": staging(spark, d), "staging_raw_text": raw_text(spark, d), "fact": f, "dim_location": dim(spark, d),
            "mart_market_analytics": market.market_mart(f), "mart_avm_features": avm_mart(spark, d)
        }
    )


@add("feature_id_check", "SELECT count(*) - count(DISTINCT listing_id) AS duplicate_listing_id_rows FROM features", FEATURES)
def _(spark, d):
    return checks.feature_ids(feature_mart(spark, d))


_COMPLETE = {
    "null_timeline_hours_imputed": "timeline_hours_imputed", "null_area_rows": "area_m2", "null_log_area_rows": "log_area_m2",
    "null_bedrooms_imputed": "bedrooms_imputed", "null_bathrooms_imputed": "bathrooms_imputed", "null_floors_imputed": "floors_imputed",
    "null_has_frontage": "has_frontage", "null_target_price": "target_price_million_vnd", "null_target_log_price": "target_log_price_million_vnd"
}


@add(
    "feature_completeness_check",
    "SELECT " + ", ".join(
        [
            _COUNT("province IS NULL OR province = ''", "null_province_rows"), _COUNT("district IS NULL OR district = ''", "null_district_rows"),
            *(_COUNT(f"{c} IS NULL", n) for n, c in _COMPLETE.items())
        ]
    ) + " FROM features",
    FEATURES
)
def _(spark, d):
    return checks.feature_completeness(feature_mart(spark, d))


@add(
    "feature_transform_check",
    "SELECT " + ", ".join(
        [
            _COUNT("abs(log_area_m2 - ln(1 + area_m2)) > 1e-6", "log_area_mismatch_rows"),
            _COUNT("abs(target_log_price_million_vnd - ln(1 + target_price_million_vnd)) > 1e-6", "log_target_mismatch_rows"),
            _COUNT("total_rooms <> bedrooms_imputed + bathrooms_imputed", "total_rooms_mismatch_rows"),
            _COUNT("has_frontage <> (coalesce(frontage_raw, 0) > 0)", "frontage_flag_mismatch_rows"),
            _COUNT("area_per_room IS NULL OR area_per_room <= 0", "invalid_area_per_room_rows")
        ]
    ) + " FROM features",
    FEATURES
)
def _(spark, d):
    return checks.feature_transforms(feature_mart(spark, d))


_REFS = {
    "null_province_listing_count_ref": "province_listing_count_ref", "null_district_listing_count_ref": "district_listing_count_ref",
    "null_province_median_price_ref": "province_median_price_million_vnd_ref",
    "null_district_median_price_ref": "district_median_price_million_vnd_ref",
    "null_district_to_province_price_ratio_ref": "district_to_province_price_ratio_ref"
}


@add("feature_reference_check", "SELECT " + ", ".join(_COUNT(f"{c} IS NULL", n) for n, c in _REFS.items()) + " FROM features", FEATURES)
def _(spark, d):
    return checks.feature_references(feature_mart(spark, d))


@add(
    "feature_flag_counts",
    "SELECT " + ", ".join(
        [
            *(_COUNT(f"is_outlier_{x}", f"{x}_outlier_rows") for x in ("area", "price", "price_per_m2", "any")),
            _COUNT("is_robust_train_candidate", "robust_train_candidate_rows")
        ]
    ) + " FROM features",
    FEATURES
)
def _(spark, d):
    return checks.feature_flags(feature_mart(spark, d))


@add(
    "feature_summary",
    "SELECT count(*) AS row_count, " + ", ".join(
        [
            *(_COUNT(f"{g}_missing", f"{g}_missing_rows") for g in ("timeline", "frontage", "bedrooms", "bathrooms", "floors")),
            _COUNT("is_outlier_area", "area_outlier_rows"), _COUNT("is_outlier_price", "price_outlier_rows"),
            _COUNT("is_outlier_price_per_m2", "price_per_m2_outlier_rows"), _COUNT("is_robust_train_candidate", "robust_train_candidate_rows")
        ]
    ) + " FROM features",
    FEATURES
)
def _(spark, d):
    return eda.feature_summary(feature_mart(spark, d))


# --- gate, log, profile
_RATIOS = [
    "null_price_ratio", "invalid_price_ratio", "null_area_ratio", "invalid_area_ratio", "duplicate_non_empty_detail_url_ratio", "fact_row_ratio"
]


@add("quality_metrics", near_sql("""SELECT *, null_price_count / total_rows::DOUBLE AS null_price_ratio,
    invalid_price_count / total_rows::DOUBLE AS invalid_price_ratio, null_area_count / total_rows::DOUBLE AS null_area_ratio,
    invalid_area_count / total_rows::DOUBLE AS invalid_area_ratio,
    duplicate_non_empty_detail_url_rows / total_rows::DOUBLE AS duplicate_non_empty_detail_url_ratio,
    fact_rows / total_rows::DOUBLE AS fact_row_ratio FROM (SELECT count(*) AS total_rows,
    count(*) FILTER (price_million_vnd IS NULL) AS null_price_count, count(*) FILTER (price_million_vnd <= 0) AS invalid_price_count,
    count(*) FILTER (area_m2 IS NULL) AS null_area_count, count(*) FILTER (area_m2 <= 0) AS invalid_area_count, (SELECT coalesce(sum(n),
    0)::BIGINT FROM (SELECT count(*) AS n FROM staging WHERE trim(detail_url) <> '' GROUP BY trim(detail_url) HAVING count(*) > 1)) AS duplicate_non_empty_detail_url_rows,
    (SELECT count(*) FROM fact) AS fact_rows FROM staging)""", *_RATIOS, digits=8), FACT)
def _(spark, d):
    return near(quality.metrics_frame(staging(spark, d), fact(spark, d)), *_RATIOS, digits=8)


@add("run_log_latest", "SELECT user_id AS run_id, max(event_id) AS sequence_id FROM events GROUP BY user_id")
def _(spark, d):
    log = spark.read.parquet(f"{d}/events.parquet").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("sequence"), F.col("event_id").alias("sequence_id")
    )
    return quality.latest_runs(log)


_MEASURES = "m AS (SELECT price_million_vnd, area_m2, price_million_vnd / nullif(area_m2, 0) AS price_per_m2 FROM staging)"
_STAT = [*profile.QUANTILES, "mean", "std"]


@add(
    "profile_stats",
    near_sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS metric, count({c}) AS \"count\", min({c}) AS \"min\", " + ", ".join(f"quantile_cont({c}, {p}) AS {n}" for n, p in profile.QUANTILES.items()) + f", max({c}) AS \"max\", avg({c}) AS mean, stddev_samp({c}) AS std FROM m" for c in profile.MEASURES
        ),
        *_STAT
    ),
    f"{STAGING}, {_MEASURES}"
)
def _(spark, d):
    return near(profile.profile_stats(raw_text(spark, d)), *_STAT)


@add(
    "profile_iqr",
    near_sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS metric, count(*) FILTER ({c} < lo OR {c} > hi) AS \"count\", count(*) FILTER ({c} < lo OR {c} > hi) / "
            f"count({c})::DOUBLE AS ratio, any_value(lo) AS lower, any_value(hi) AS upper FROM m CROSS JOIN (SELECT quantile_cont({c}, 0.25) - "
            f"1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - "
            f"quantile_cont({c}, 0.25)) AS hi FROM m)" for c in profile.MEASURES
        ),
        "ratio", "lower", "upper"
    ),
    f"{STAGING}, {_MEASURES}"
)
def _(spark, d):
    return near(profile.profile_iqr(raw_text(spark, d)), "ratio", "lower", "upper")


@add("profile_location_segments", "SELECT len(string_split(location, ','))::INT AS n_segments, count(*) AS n FROM staging GROUP BY ALL", STAGING)
def _(spark, d):
    return profile.segment_distribution(raw_text(spark, d))


@add("profile_top_locations", "SELECT location, count(*) AS n FROM staging GROUP BY location ORDER BY n DESC, location LIMIT 20", STAGING)
def _(spark, d):
    return profile.top_values(raw_text(spark, d), "location")


@add(
    "profile_location_uniques",
    "SELECT count(DISTINCT location) AS unique_location_raw, count(DISTINCT split_part(location, ', ', 2)) AS unique_province_raw, "
    "count(DISTINCT split_part(location, ', ', 1)) AS unique_district_raw, count(DISTINCT lower(split_part(location, ', ', 2))) AS "
    "unique_province_normalized, count(DISTINCT lower(split_part(location, ', ', 1))) AS unique_district_normalized FROM staging",
    STAGING
)
def _(spark, d):
    return profile.location_uniques(raw_text(spark, d))


_REP = lambda key, where, name: f"(SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM staging {where} GROUP BY {key} HAVING count(*) > 1)) AS {name}_rows, (SELECT count(*) FROM (SELECT 1 FROM staging {where} GROUP BY {key} HAVING count(*) > 1)) AS {name}_keys"


@add(
    "profile_duplicates",
    f"SELECT {_REP('id', '', 'duplicate_id')}, {_REP('detail_url', '', 'duplicate_detail_url_all')}, "
    f"{_REP('detail_url', 'WHERE length(detail_url) > 0', 'duplicate_detail_url')}, (SELECT count(*) FROM staging) - (SELECT count(*) FROM "
    "(SELECT DISTINCT * FROM staging)) AS full_row_duplicates",
    STAGING
)
def _(spark, d):
    return profile.duplicates(raw_text(spark, d))


@add(
    "profile_missing",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS \"count\", round(count(*) FILTER ({c} IS NULL) / count(*)::DOUBLE + "
        "1e-9, 8) AS ratio FROM staging" for c in (
            "id", "detail_url", "title", "location", "timeline_hours", "area_m2", "bedrooms", "bathrooms", "floors", "frontage", "price_million_vnd"
        )
    ),
    STAGING
)
def _(spark, d):
    return near(profile.missing(raw_text(spark, d)), "ratio", digits=8)


# --- encoders
_TEST = "listing_id LIKE '%3-%'"
_SPLIT = "train AS (SELECT * FROM features WHERE NOT (listing_id LIKE '%3-%')), test AS (SELECT * FROM features WHERE listing_id LIKE '%3-%')"
_fit = lambda level, keys, source: f"SELECT {keys}, count(listing_id) AS {level}_listing_count, quantile_cont(target_price_million_vnd, 0.5) AS {level}_median_price_million_vnd, quantile_cont(target_price_per_m2, 0.5) AS {level}_median_price_per_m2, count(*) / (SELECT count(*) FROM {source})::DOUBLE AS {level}_frequency FROM {source} GROUP BY ALL"
_ENCODE = f"{FEATURES}, {_SPLIT}, ep AS ({_fit('province', 'province', 'train')}), ed AS ({_fit('district', 'province, district', 'train')})"


def _reference(spark, d):
    rows = feature_mart(spark, d)
    return encoders.fit_reference(rows.filter(f"NOT ({_TEST})"), distributed=True), rows.filter(_TEST)


for _level in ("province", "district"):

    @add(f"encoder_fit_{_level}", near_sql(f"SELECT * FROM e{_level[0]}", f"{_level}_frequency", digits=8), _ENCODE)
    def _(spark, d, level=_level):
        return near(getattr(_reference(spark, d)[0], level), f"{level}_frequency", digits=8)


_APPLIED = """SELECT listing_id, coalesce(province_listing_count, 0) AS province_listing_count, coalesce(district_listing_count,
    0) AS district_listing_count, coalesce(province_frequency, 0) AS province_frequency, coalesce(district_frequency,
    0) AS district_frequency,
    coalesce(province_median_price_million_vnd, g1) AS province_median_price_million_vnd, coalesce(province_median_price_per_m2,
    g2) AS province_median_price_per_m2,
    coalesce(district_median_price_million_vnd, province_median_price_million_vnd, g1) AS district_median_price_million_vnd,
    coalesce(district_median_price_per_m2, province_median_price_per_m2, g2) AS district_median_price_per_m2,
    coalesce(coalesce(district_median_price_million_vnd, province_median_price_million_vnd,
    g1) / nullif(coalesce(province_median_price_million_vnd, g1), 0), 1) AS district_to_province_price_ratio,
    coalesce(coalesce(district_median_price_per_m2, province_median_price_per_m2, g2) / nullif(coalesce(province_median_price_per_m2, g2), 0),
    1) AS district_to_province_price_per_m2_ratio
    FROM test LEFT JOIN ep ON ep.province = test.province LEFT JOIN ed ON ed.province = test.province AND ed.district = test.district
    CROSS JOIN (SELECT quantile_cont(target_price_million_vnd, 0.5) AS g1, quantile_cont(target_price_per_m2, 0.5) AS g2 FROM train)"""
_SHAPED = ["province_frequency", "district_frequency", "district_to_province_price_ratio", "district_to_province_price_per_m2_ratio"]


@add("encoder_apply", near_sql(_APPLIED, *_SHAPED, digits=8), _ENCODE)
def _(spark, d):
    ref, test = _reference(spark, d)
    return near(encoders.apply_reference(test, ref).select("listing_id", *encoders.REFERENCE_COLUMNS), *_SHAPED, digits=8)


@add("encoder_oof", near_sql("""WITH folded AS (SELECT *, (length(listing_id) + split_part(listing_id, '-',
    1)::BIGINT % 3)::INT % 3 AS fold FROM features), dealt AS (SELECT f.* EXCLUDE (fold),
    k AS fold FROM folded f CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) WHERE f.fold <> k),
    t AS (SELECT fold, count(*)::DOUBLE AS n, quantile_cont(target_price_million_vnd, 0.5) AS g1 FROM dealt GROUP BY fold), p AS (SELECT fold,
    province, count(*) AS c, quantile_cont(target_price_million_vnd, 0.5) AS m FROM dealt GROUP BY ALL), q AS (SELECT fold, province,
    district, count(*) AS c, quantile_cont(target_price_million_vnd, 0.5) AS m FROM dealt GROUP BY ALL)
    SELECT listing_id, f.fold, coalesce(p.c, 0) AS province_listing_count, coalesce(q.c, 0) AS district_listing_count, coalesce(q.c / t.n,
    0) AS district_frequency, coalesce(p.m, g1) AS province_median_price_million_vnd, coalesce(q.m, p.m,
    g1) AS district_median_price_million_vnd
    FROM folded f JOIN t ON t.fold = f.fold LEFT JOIN p ON p.fold = f.fold AND p.province = f.province LEFT JOIN q ON q.fold = f.fold AND q.province = f.province AND q.district = f.district""", "district_frequency", digits=8), FEATURES)
def _(spark, d):
    """Folds that another engine can make too; the operator's own are hashed."""
    fold = ((F.length("listing_id") + F.split("listing_id", "-")[0].cast("long") % 3) % 3).cast("int")
    rows = encoders.out_of_fold(feature_mart(spark, d), 3, fold=fold)
    return near(
        rows.select(
            "listing_id", "fold", "province_listing_count", "district_listing_count", "district_frequency", "province_median_price_million_vnd",
            "district_median_price_million_vnd"
        ),
        "district_frequency", digits=8
    )


@add(
    "linear_topk_other",
    "SELECT CASE WHEN f.district IN (SELECT district FROM (SELECT district, count(*) AS n FROM fact GROUP BY district ORDER BY n DESC, "
    "district LIMIT 50)) THEN f.district ELSE 'Other' END AS district_for_ohe, count(*) AS n FROM fact f GROUP BY ALL",
    FACT
)
def _(spark, d):
    return encoders.top_or_other(
        fact(spark, d).select("district"), "district", 50, "district_for_ohe"
    ).groupBy("district_for_ohe").agg(F.count(F.lit(1)).alias("n"))


_LEVELS = ("0_24h", "1_3d", "3_7d", "7_30d", "gt_30d", "unknown")


@add(
    "linear_one_hot",
    "SELECT listing_id, " + ", ".join(f"(timeline_bucket = '{x}')::INT AS timeline_bucket_{x}" for x in _LEVELS) + ", total_rooms FROM features",
    FEATURES
)
def _(spark, d):
    rows = feature_mart(spark, d)
    return encoders.linear_frame(rows, encoders.fit_reference(rows, distributed=True)).select(
        "listing_id", *(f"timeline_bucket_{x}" for x in _LEVELS), "total_rooms"
    )


@add("tree_frame", "SELECT listing_id, province, district, timeline_bucket, total_rooms, is_outlier_area FROM features", FEATURES)
def _(spark, d):
    rows = feature_mart(spark, d)
    return encoders.tree_frame(rows, encoders.fit_reference(rows, distributed=True))[0].select(
        "listing_id", "province", "district", "timeline_bucket", "total_rooms", "is_outlier_area"
    )


@add(
    "date_dim_sequence",
    "SELECT strftime(d, '%Y%m%d')::INT AS date_id, d::DATE AS full_date, year(d)::INT AS year, quarter(d)::INT AS quarter, month(d)::INT AS "
    "month, week(d)::INT AS week FROM (SELECT unnest(generate_series(DATE '2020-12-20', DATE '2022-01-10', INTERVAL 1 DAY)) AS d)"
)
def _(spark, d):
    return facts.dim_time("2020-12-20", "2022-01-10", spark)
