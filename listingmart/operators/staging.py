"""Raw texts to typed staging rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import coerce_frontage, safe_double, safe_int, strip
from ..schemas import FLOAT_COLUMNS, INT_COLUMNS, RAW_COLUMNS


def cast_numeric(df: DataFrame, ints: list[str], floats: list[str]) -> DataFrame:
    """Texts that are no numbers become null; fractions in int columns are cut off."""
    return df.withColumns({c: safe_int(F.col(c)) for c in ints} | {c: safe_double(F.col(c)) for c in floats})


def build_staging(raw: DataFrame) -> DataFrame:
    """The id is not trimmed; the other texts are."""
    out = raw.withColumns({c: strip(F.col(c)) for c in ("detail_url", "title", "location")})
    return cast_numeric(out, INT_COLUMNS, FLOAT_COLUMNS).withColumn("frontage", coerce_frontage(F.col("frontage"))).select(*RAW_COLUMNS)


def build_staging_strict(raw: DataFrame) -> DataFrame:
    """The bulk-load variant: blanks are null, other texts that are no numbers fail the query."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    number = lambda c, kind: text(c).cast(kind)
    low = F.lower(F.trim("frontage"))
    frontage = F.when(low.isin("true", "t", "1"), 1.0).when(low.isin("false", "f", "0"), 0.0).when(
        F.trim("frontage").rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.trim("frontage").try_cast("double")
    )
    return raw.select(
        *(text(c).alias(c) for c in ("id", "detail_url", "title", "location")), number("timeline_hours", "int").alias("timeline_hours"),
        number("area_m2", "double").alias("area_m2"),
        *(number(c, "int").alias(c) for c in ("bedrooms", "bathrooms", "floors")), frontage.alias("frontage"),
        number("price_million_vnd", "double").alias("price_million_vnd"))
