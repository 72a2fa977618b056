"""Province and district from "district, province" texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_spaces, normalize_token, strip, title

#: Short names of provinces.
PROVINCE_ALIASES = {
    "hcm": "ho chi minh", "tp hcm": "ho chi minh", "tphcm": "ho chi minh", "ho chi minh city": "ho chi minh", "hn": "ha noi", "dn": "da nang"
}


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# The prefixes in the patterns below are fixed values.
def normalize_province(c: Column) -> Column:
    name = F.regexp_replace(normalize_token(c), r"^(tp|thanh pho|tinh)\s+", "")
    known = F.create_map(*[F.lit(x) for pair in PROVINCE_ALIASES.items() for x in pair])
    return blank_to_null(title(F.coalesce(F.try_element_at(known, name), name)))


def normalize_district(c: Column, strict_prefix: bool = False) -> Column:
    """strict_prefix: a district's "h" prefix needs a space behind it. Without it any name that starts with "h"
    is read as prefixed, as published results were made."""
    name = normalize_token(c)
    rural = r"^(?:huyen|h)\s+(.+)$" if strict_prefix else r"^(?:huyen|h)\s*(.+)$"
    urban = r"^(?:quan|q)\s*([0-9]+)$"
    rest = normalize_spaces(F.regexp_replace(name, r"^(quan|q|huyen|h|thi xa|tx|thanh pho|tp)\s+", ""))
    return (
        F.when(name.rlike(urban), F.concat(F.lit("Quan "), F.regexp_extract(name, urban, 1)))
        .when(name.rlike(rural), F.concat(F.lit("Huyen "), title(F.regexp_extract(name, rural, 1))))
        .otherwise(blank_to_null(title(rest))))


def segments(location: Column) -> Column:
    """Non-empty comma-separated parts."""
    return F.filter(F.transform(F.split(location, ","), strip), lambda x: x != "")


def extract_location(location: Column, strict_prefix: bool = False) -> tuple[Column, Column]:
    """(province, district): the last part and the one before; null if absent."""
    parts = segments(F.coalesce(location, F.lit("")))
    return normalize_province(F.try_element_at(parts, F.lit(-1))), F.when(
        F.size(parts) > 1, normalize_district(F.try_element_at(parts, F.lit(-2)), strict_prefix)
    )


def known(c: Column) -> Column:
    """Unknown for null and blank."""
    return F.coalesce(blank_to_null(strip(c)), F.lit("Unknown"))


def legacy_places(location: Column) -> tuple[Column, Column]:
    """(province, district) as an older SQL load had them: the second and the first part whatever their number, with
    capitals and marks kept. Only for comparison with tables of that load."""
    part = lambda k: strip(F.split_part(location, F.lit(","), F.lit(k)))
    runs = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
    return known(F.array_join(F.transform(runs(part(2)), capital), "")), known(F.array_join(F.transform(runs(part(1)), capital), ""))
