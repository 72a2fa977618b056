"""Raw listing files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import NA_TOKENS, RAW_COLUMNS, RAW_TEXT


def missing_to_null(df: DataFrame) -> DataFrame:
    return df.select(*(F.when(~F.col(c).isin(NA_TOKENS), F.col(c)).alias(c) for c in df.columns))


def read_raw_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, by name (extra columns of the file are left out); missing tokens become null."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").option("nullValue", "").csv(path)
    return missing_to_null(rows.select(*(F.col(c).cast("string") for c in RAW_COLUMNS)))


def read_copy(spark: SparkSession, path: str) -> DataFrame:
    """The bulk-load variant: only an empty field is null. The header is taken in the fixed order."""
    return spark.read.schema(RAW_TEXT).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "").csv(path)


def raw_landing(raw: DataFrame) -> DataFrame:
    return raw.select(*RAW_COLUMNS)
