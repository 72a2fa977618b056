"""A listing table derived from the star-schema test tables, deterministic and expressible in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RAW_COLUMNS

_FIELDS = """
    concat(l_orderkey, '-', l_linenumber) AS id,
    CASE WHEN l_linenumber % 7 = 0 THEN '' ELSE concat('u/', l_orderkey, '/', l_linenumber) END AS detail_url,
    concat(CAST(l_shipdate AS DATE), ' ', l_partkey) AS title,
    concat(n_name, ' ', l_partkey % 40, ', ', r_name) AS location,
    CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE {days} % 1000 END AS timeline_hours,
    CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS area_m2,
    CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(l_partkey % 9 + 1 AS INT) END AS bedrooms,
    CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(l_suppkey % 4 + 1 AS INT) END AS bathrooms,
    CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE CAST(l_linenumber % 5 + 1 AS INT) END AS floors,
    CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_suppkey % 2 AS DOUBLE) END AS frontage,
    CAST(l_extendedprice AS DOUBLE) AS price_million_vnd
"""
#: The same rows for another SQL engine.
STAGING_SQL = "SELECT" + _FIELDS.format(days="datediff('day', l_shipdate::DATE, DATE '2001-12-31')") + """
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed staging rows. The small dimensions are joined first, lineitem once."""
    read = lambda name, *cols: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)
    place = read("nation", "n_nationkey", "n_name", "n_regionkey").join(
        read("region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    customer = read("customer", "c_custkey", "c_nationkey").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = read("orders", "o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    lines = read("lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = lines.withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    fields = _FIELDS.format(days="cast(datediff(date'2001-12-31', l_shipdate) AS int)")
    return rows.selectExpr(*[x.strip() for x in fields.strip().split(",\n")]).select(*RAW_COLUMNS)


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows as a raw file's reader gives them: texts with blanks, true/false words; missing values null."""
    rows = staging(spark, sf_dir)
    padded = [
        F.concat(F.lit(" "), F.col(c).cast("string"), F.lit("\t")).alias(c) for c in ("timeline_hours", "area_m2", "bedrooms", "bathrooms", "floors")
    ]
    frontage = F.when(F.col("frontage") == 1, " True").when(F.col("frontage") == 0, "f").alias("frontage")
    title = F.concat(F.lit("  "), "title", F.lit(" ")).alias("title")
    return rows.select(
        "id", "detail_url", title, "location", *padded, frontage, F.col("price_million_vnd").cast("string").alias("price_million_vnd")
    ).select(*RAW_COLUMNS)
