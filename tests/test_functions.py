from __future__ import annotations

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listingmart.functions import buckets, location, stats, text
from listingmart.plans import report


def one(spark, column, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}").select("i", column(F.col("c")).alias("o")).orderBy("i")
    return [r["o"] for r in rows.collect()]


def test_numbers(spark):
    given_ = [" 12 ", "3.0", "2.5", "1e3", "abc", "", "2d", "1,000", "0x10", "\t7\n", "-4", ".5", None, "1e99"]
    assert one(spark, text.safe_double, given_) == [12.0, 3.0, 2.5, 1000.0, None, None, None, None, None, 7.0, -4.0, 0.5, None, 1e99]
    assert one(spark, text.safe_int, given_) == [12, 3, 2, 1000, None, None, None, None, None, 7, -4, 0, None, None]
    assert one(spark, text.safe_double, ["inf", "-Infinity"]) == [float("inf"), float("-inf")]


def test_frontage(spark):
    assert one(
        spark, text.coerce_frontage, ["true", " T ", "1", "False", "f", "0", "2.5", "x", None]
    ) == [1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 2.5, None, None]


def test_accents(spark):
    words = ["Đống Đa", "Thừa Thiên Huế", unicodedata.normalize("NFD", "Đà Nẵng"), " á ", "", None, "plain"]
    assert one(spark, text.remove_accents, words) == ["Dong Da", "Thua Thien Hue", "Da Nang", "a", "", "", "plain"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x24F, exclude_categories=["Cs", "Cc"]), max_size=12), min_size=1, max_size=30))
def test_accents_like_unicode(spark, words):
    def plain(s):
        s = s.strip().replace("đ", "d").replace("Đ", "D")
        return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn"))

    assert one(spark, text.remove_accents, words) == [plain(w) for w in words]


def test_title(spark):
    assert one(spark, text.title, ["quan 1a", "m'drak", "krong a-na", ""]) == ["Quan 1A", "M'Drak", "Krong A-Na", ""]


@pytest.mark.parametrize(("place", "expected"), [
    ("Q 12, TP HCM", ("Ho Chi Minh", "Quan 12")), ("Đống Đa, Hà Nội", ("Ha Noi", "Dong Da")), ("Hoàn Kiếm, Hà Nội", ("Ha Noi", "Huyen Oan Kiem")),
    ("A, B, C", ("C", "B")), ("Hà Nội", ("Ha Noi", None)),
    ("", (None, None)), (None, (None, None)), (",", (None, None)), ("huyen Cu Chi, tinh X", ("X", "Huyen Cu Chi")),
    ("TX Son Tay, HN", ("Ha Noi", "Son Tay"))])
def test_location(spark, place, expected):
    province, district = location.extract_location(F.col("c"))
    row = spark.createDataFrame([(place,)], "c string").select(province.alias("p"), district.alias("d")).first()
    assert (row["p"], row["d"]) == expected


def test_strict_prefix(spark):
    assert one(spark, lambda c: location.normalize_district(c, strict_prefix=True), ["Hoàn Kiếm", "h Cu Chi"]) == ["Hoan Kiem", "Huyen Cu Chi"]


def test_buckets(spark):
    hours = [None, -1, 0, 23, 24, 71, 72, 167, 168, 719, 720, 721]
    assert one(spark, buckets.bucket, hours, "int") == [
        "unknown", "0_24h", "0_24h", "0_24h", "24_72h", "24_72h", "3_7d", "3_7d", "8_30d", "8_30d", "gt_30d", "gt_30d"
    ]
    assert one(spark, lambda c: buckets.bucket(c, buckets.USER), [24, 168], "int") == ["1_3d", "7_30d"]
    assert one(spark, buckets.ordinal, ["0_24h", "gt_30d", "unknown"]) == [1, 5, 99]


def test_statistics(spark):
    rows = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, 1.0), (3.0, 5.0, 2.0), (4.0, 5.0, 4.0)], "x double, k double, y double")
    got = rows.agg(
        stats.median("x").alias("m"), stats.lower_median("x").alias("l"), stats.corr("x", "k").alias("c"), stats.corr("x", "y").alias("r"),
        stats.skew_adjusted("k").alias("s"), stats.skew_adjusted("y").alias("t")
    ).first()
    assert (got["m"], got["l"], got["c"], got["s"]) == (2.5, 2, None, None)
    assert got["r"] == pytest.approx(0.9819805060619659)
    assert got["t"] == pytest.approx(0.9352195295828237)
    none = rows.filter("x > 9").agg(stats.median("x").alias("m"), stats.lower_median("x").alias("l"), stats.corr("x", "y").alias("c")).first()
    assert tuple(none) == (None, None, None)


def test_legacy_places(spark):
    df = spark.createDataFrame([("quận 1a, HÀ NỘI",), ("a, b, c",), ("x",), (None,)], "location string")
    province, district = location.legacy_places(F.col("location"))
    got = [tuple(r) for r in df.select(province, district).collect()]
    assert got == [("Hà Nội", "Quận 1a"), ("B", "A"), ("Unknown", "X"), ("Unknown", "Unknown")]


def test_told():
    assert [report.told(x) for x in (66912, 0.5, 1234.5678, True, None, "a")] == ["66,912", "0.5", "1,234.5678", "True", "None", "a"]
    assert report.percent(0.2476) == "24.76%" and "- null_area_ratio: 24.76%" in report.markdown("t", {"x": {"null_area_ratio": 0.2476}})
