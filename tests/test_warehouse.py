from __future__ import annotations

from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from listingmart.operators import checks, encoders, fact, quality
from listingmart.operators.quantiles import exact_quantiles
from listingmart.operators.staging import build_staging, build_staging_strict
from listingmart.plans import avm, eda, features, figures, market, pipelines, profile
from listingmart.schemas import RAW_COLUMNS, STAGING
from listingmart.sources import scratch
from listingmart.sources.csvfile import read_copy, read_raw_text
from listingmart.sources.tables import ConcurrentReplacementError, Warehouse


def staging(spark, *rows):
    base = {
        "id": "1", "detail_url": "u", "title": "t", "location": "Q 1, HN", "timeline_hours": 5, "area_m2": 10.0, "bedrooms": None, "bathrooms": None,
        "floors": None, "frontage": None, "price_million_vnd": 100.0
    }
    return spark.createDataFrame([tuple((base | r)[c] for c in RAW_COLUMNS) for r in rows], STAGING)


def test_fact(spark):
    rows = staging(
        spark, {"id": "1", "timeline_hours": 9}, {"id": "1", "timeline_hours": 2, "price_million_vnd": 1200.0},
        {"id": "2", "detail_url": " ", "location": ""},
        {"id": "3", "detail_url": "w", "price_million_vnd": 0.0}, {"id": "4", "detail_url": "x", "timeline_hours": None, "area_m2": 8.0})
    got = {r["listing_id"]: r for r in fact.build_fact(rows).collect()}
    assert sorted(got) == ["1", "2", "4"]
    assert (got["1"]["timeline_hours"], got["1"]["price_per_m2"], got["1"]["province"], got["1"]["district"]) == (2, 120.0, "Ha Noi", "Quan 1")
    assert (got["2"]["province"], got["2"]["district"], got["2"]["detail_url"]) == ("Unknown", "Unknown", None)


def test_dedupe_order(spark):
    rows = staging(
        spark, {"id": "b", "timeline_hours": None, "floors": 1}, {"id": "a", "timeline_hours": 3}, {"id": "c", "timeline_hours": 3, "bedrooms": 2},
        {"id": "d", "timeline_hours": 3, "bathrooms": 2}
    )
    assert [r["id"] for r in fact.dedupe_latest(rows).collect()] == ["c"]


def test_id_conflict(spark):
    with pytest.raises(fact.DuplicateListingError, match="'1'"):
        fact.build_fact(staging(spark, {"detail_url": "a"}, {"detail_url": "b"}))


def test_empty(spark):
    none = staging(spark, {}).filter("id is null")
    f = fact.build_fact(none)
    assert f.count() == 0 and market.market_mart(f).count() == 0
    a = avm.avm_mart(f, fact.dim_location(f))
    assert a.count() == 0 and features.feature_mart(a).count() == 0
    assert quality.metrics(none, f)["fact_row_ratio"] == 0.0
    assert eda.missing_summary(f).first()["missing_pct"] == 0.0


def test_quality(spark):
    rows = staging(
        spark, {"detail_url": "a", "price_million_vnd": None}, {"detail_url": "a ", "price_million_vnd": -1.0}, {"detail_url": "", "area_m2": None},
        {"detail_url": "b", "area_m2": 0.0}
    )
    got = quality.metrics(rows, rows.limit(2).select(F.col("id").alias("listing_id")))
    assert [
        got[k] for k in (
            "total_rows", "fact_rows", "null_price_count", "invalid_price_count", "null_area_count", "invalid_area_count",
            "duplicate_non_empty_detail_url_rows"
        )
    ] == [4, 2, 1, 1, 1, 1, 2]
    with pytest.raises(quality.QualityGateError, match="null_price_ratio=0.2500 > 0.1000"):
        quality.enforce(got)
    quality.enforce(got, quality.Thresholds(0.25, 0.25, 0.25, 0.25, 0.5, 0.5))  # at the thresholds


@pytest.mark.parametrize(("observed", "level"), [(29, "province"), (30, "district")])
def test_imputation_levels(spark, observed, level):
    f = [
        {"id": f"d{i}", "detail_url": f"d{i}", "location": "D1, P", "bedrooms": 1} for i in range(observed)
    ] + [{"id": f"p{i}", "detail_url": f"p{i}", "location": "D2, P", "bedrooms": 7} for i in range(40)]
    f += [{"id": "gap", "detail_url": "gap", "location": "D1, P"}, {"id": "far", "detail_url": "far", "location": "E, Z"}]
    rows = fact.build_fact(staging(spark, *f))
    got = {r["listing_id"]: r for r in avm.avm_mart(rows, fact.dim_location(rows)).filter("bedrooms is null").collect()}
    assert got["gap"]["bedrooms_imputed"] == (1 if level == "district" else 7) and got["gap"]["bedrooms_missing"]
    assert got["far"]["bedrooms_imputed"] == 7 and got["far"]["location_id"] is not None


def test_marts(spark, data):
    from listingmart import queries as q

    f = q.fact(spark, data).persist()
    a = avm.avm_mart(f, fact.dim_location(f)).persist()
    m = features.feature_mart(a).persist()
    n = f.count()
    assert a.count() == n and m.count() == n
    assert a.filter("is_robust_train_candidate = is_outlier_any").count() == 0
    assert m.filter("timeline_hours_capped_p99 > coalesce(timeline_hours, 1e9) or area_m2_capped_p99 > area_m2 or area_per_room <= 0").count() == 0
    assert market.reconcile_counts(market.market_mart(f), f).first()["mismatch_group_count"] == 0
    assert all(v == 0 for v in checks.feature_completeness(m).first())
    assert all(v == 0 for v in checks.feature_transforms(m).first())


def frame(spark, *rows):
    return spark.createDataFrame(
        list(rows), "listing_id string, province string, district string, target_price_million_vnd double, target_price_per_m2 double"
    )


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 999, 30_000])
def test_exact_quantiles(spark, n):
    rows = spark.range(n).select(
        F.when(F.col("id") % 7 != 3, F.rand(1) * 1000).alias("x"), (F.col("id") % 5).cast("int").alias("y"), F.lit(None).cast("double").alias("z")
    )
    at = (0.0, 0.01, 0.25, 0.5, 0.75, 0.995, 1.0)
    got = exact_quantiles(rows, {"x": at, "y": (0.5,), "z": (0.5,)}).first()
    want = rows.agg(*(F.percentile(c, F.array(*map(F.lit, p))).alias(c) for c, p in (("x", at), ("y", (0.5,)), ("z", (0.5,))))).first()
    for c in ("x", "y", "z"):
        assert got[c] == ([None] * len(got[c]) if want[c] is None else pytest.approx(want[c], rel=1e-12))


def test_exact_quantiles_of_groups(spark):
    """A null group, a group of one value, one without values and a hot one with many distinct values."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 == 0, "same").when(F.col("id") % 7 == 1, "none").when(F.col("id") % 7 == 2, "few").alias("g"),
        F.when(F.col("id") % 21 == 0, 5.0).when((F.col("id") % 3 == 0) & (F.col("id") % 7 == 1), None).otherwise(F.rand(3) * F.rand(4)).alias("x"))
    at = (0.0, 0.1, 0.5, 0.99, 1.0)
    got = {r["g"]: r["x"] for r in exact_quantiles(rows, {"x": at}, ["g"]).collect()}
    want = {r["g"]: r["x"] for r in rows.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, at))).alias("x")).collect()}
    assert got.keys() == want.keys() and len(got) == 5
    assert all(got[g] == ([None] * 5 if want[g] is None else pytest.approx(want[g], rel=1e-12)) for g in want)


def test_replacements_at_once(spark, tmp_path):
    """The second of two writers that saw the same state fails, and readers keep the version before."""
    one, two = Warehouse(spark, f"file://{tmp_path}"), Warehouse(spark, f"file://{tmp_path}")
    one.replace(spark.range(3), "t")
    before, held = two._pointers("t"), one.read("t")
    one.replace(spark.range(5), "t")
    two._pointers = lambda name: before
    with pytest.raises(ConcurrentReplacementError):
        two.replace(spark.range(9), "t")
    assert one.read("t").count() == 5 and held.count() == 3


def test_encoder_unseen(spark):
    ref = encoders.fit_reference(frame(spark, ("1", "P", "D", 10.0, 0.0), ("2", "P", "D", 30.0, 0.0), ("3", None, None, 5.0, 1.0)))
    got = {
        r["listing_id"]: r for r in encoders.apply_reference(
            frame(spark, ("a", "P", "new", 0.0, 0.0), ("b", "new", "new", 0.0, 0.0), ("c", " P ", "D", 0.0, 0.0)), ref
        ).collect()
    }
    assert (
        got["a"]["district_listing_count"], got["a"]["district_median_price_million_vnd"], got["a"]["district_to_province_price_ratio"]
    ) == (0, 20.0, 1.0)
    assert (got["b"]["province_listing_count"], got["b"]["province_frequency"], got["b"]["province_median_price_million_vnd"]) == (0, 0.0, 10.0)
    assert got["c"]["province_listing_count"] == 2 and got["c"]["district_to_province_price_per_m2_ratio"] == 1.0


def test_out_of_fold_does_not_leak(spark):
    rows = [(str(i), "P", f"D{i % 2}", float(i), float(i)) for i in range(20)]
    before = {r["listing_id"]: r for r in encoders.out_of_fold(frame(spark, *rows), 4).collect()}
    rows[7] = ("7", "P", "D1", 1e6, 1e6)
    after = {r["listing_id"]: r for r in encoders.out_of_fold(frame(spark, *rows), 4).collect()}
    assert before["7"] == after["7"] and len(after) == 20 and any(before[k] != after[k] for k in before)
    with pytest.raises(ValueError):
        encoders.out_of_fold(frame(spark, *rows), 1)
    with pytest.raises(ValueError):
        encoders.out_of_fold(frame(spark, *rows[:2]), 3)


def test_positional_folds(spark):
    rows = encoders.positional_fold(frame(spark, *[(str(i), "P", "D", 1.0, 1.0) for i in range(6)]), 3)
    assert [r["fold"] for r in rows.orderBy("listing_id").collect()] == [0, 1, 2, 0, 1, 2]


def test_tables(spark, tmp_path):
    house = Warehouse(spark, f"file://{tmp_path}")
    assert not house.exists("t")
    house.replace(spark.range(3), "t")
    old = house.read("t")
    assert house.replace(old.filter("id > 0"), "t").count() == 2  # reads the version it replaces
    house.append(spark.range(1), "t")
    assert house.count("t") == 3 and old.count() == 3  # readers of the version before are not cut off
    house.replace(spark.range(7), "t")
    assert house.count("t") == 7 and len(list((tmp_path / "t").glob("v*"))) == 2


CSV = 'title,id,detail_url,location,timeline_hours,area_m2,bedrooms,bathrooms,floors,frontage,price_million_vnd,extra\n"a, ""b""",1, u1 ,"Q 12, TP HCM",5,10,2.5,NA,,True,1000,x\nt,2,,,"",N/A,null,1,2,f,abc,y\n'


def test_csv_and_pipeline(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(CSV)
    raw = read_raw_text(spark, str(path))
    assert raw.columns == RAW_COLUMNS
    got = {r["id"]: r for r in build_staging(raw).collect()}
    assert (
        got["1"]["title"], got["1"]["detail_url"], got["1"]["bedrooms"], got["1"]["bathrooms"], got["1"]["frontage"]
    ) == ('a, "b"', "u1", 2, None, 1.0)
    assert (got["2"]["area_m2"], got["2"]["price_million_vnd"], got["2"]["detail_url"], got["2"]["location"]) == (None, None, None, None)
    root = f"file://{tmp_path}/house"
    with pytest.raises(quality.QualityGateError):
        pipelines.run_load(spark, raw, root)
    house = Warehouse(spark, root)
    assert house.count("stg_listings_raw_text") == 2 and house.count("stg_listings_raw") == 2 and not house.exists("fact_listings")
    assert [r["status"] for r in quality.RunLog(house).latest().collect()] == ["failed"]
    run = pipelines.run_load(spark, raw, root, skip_gate=True)
    assert run["fact_rows"] == 1 and run["mart_avm_features_rows"] == 1
    assert pipelines.run_features(spark, root, str(tmp_path / "f"))["row_count"] == 1
    assert pipelines.run_explore(spark, root, str(tmp_path / "e"))["Rows"]["fact"] == 1
    assert pipelines.run_profile(spark, str(path), str(tmp_path / "p"))["row_count"] == 2
    assert pipelines.run_checks(spark, root)["location_ids"] == [{"avm_rows_without_location_id": 0}]
    drawn = sorted((tmp_path / "e" / "figures").glob("*.svg"))
    assert len(drawn) == 6 and all(ElementTree.parse(f).getroot().tag.endswith("svg") for f in drawn)
    assert (tmp_path / "e" / "eda_summary.md").exists() and pipelines.load_final(house).count() == 1


def test_figures():
    """Marks for every value, on round scales."""
    assert figures.ticks(7) == [0, 2, 4, 6, 8] and figures.ticks(1000)[-1] >= 1000 and figures.ticks(0.3)[-1] >= 0.3
    made = figures.bars("t <&>", [("a", 3.0), ("b", 0.0)], "n")
    assert "".join(made.parts).count("<rect") == 2 and "&lt;&amp;&gt;" in made.parts[0]
    assert figures.tint(1.0) == "#2a78d6" and figures.tint(0.0) == figures.MIDDLE_HEX
    for empty in (
        figures.histogram("", [], ""), figures.bars("", [], ""), figures.boxes("", [], "k", 1.0), figures.points("", [], "x", "y"),
        figures.matrix("", [])
    ):
        ElementTree.fromstring(figures.page([empty]))


def test_strict_copy(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(",".join(RAW_COLUMNS) + "\n1, u ,t,\"a, b\",5,1.5,2,,3,T,9\n2,u,t,l,5,1.5,abc,,3,T,9\n")
    raw = read_copy(spark, str(path))
    assert build_staging_strict(raw.filter("id = 1")).first()["frontage"] == 1.0
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        build_staging_strict(raw).collect()


def test_profile_duplicates(spark):
    rows = staging(
        spark, {"id": "1", "detail_url": "a"}, {"id": "1", "detail_url": "a"}, {"id": None, "detail_url": None}, {"id": None, "detail_url": "b"},
        {"id": "2", "detail_url": ""}
    )
    got = profile.duplicates(rows).first().asDict()
    assert got == {
        "duplicate_id_rows": 4, "duplicate_id_keys": 2, "duplicate_detail_url_all_rows": 2, "duplicate_detail_url_all_keys": 1,
        "duplicate_detail_url_rows": 2, "duplicate_detail_url_keys": 1, "full_row_duplicates": 1
    }


def test_add_missing(spark):
    days = fact.dim_time("2021-01-01", "2021-01-03", spark)
    assert [r["week"] for r in days.orderBy("date_id").collect()] == [53, 53, 53]
    assert fact.add_missing(days.limit(1), days, "date_id").count() == 2


def test_scratch_paths(spark):
    """A bare path gets its file system's scheme, so that other readers than Spark find it."""
    assert scratch.qualified(spark, "/a/b") == "file:/a/b" and scratch.qualified(spark, "hdfs://n/a") == "hdfs://n/a"
    assert scratch.scratch_root(spark).startswith("file:") and scratch.materialize(spark.range(3), "t").count() == 3


def test_profile_distributed(spark):
    """No reducer holds every distinct value; a crowd of values, both signs, zero and none known."""
    rows = spark.range(5_000).select(
        F.when(F.col("id") % 5 == 0, -F.rand(1)).when(F.col("id") % 5 == 1, 0.0).otherwise(1e9 + F.rand(2)).alias("price_million_vnd"),
        F.lit(None).cast("double").alias("area_m2")
    )
    got = profile.profile_stats(rows)
    assert "percentile(" not in got._jdf.queryExecution().optimizedPlan().toString()
    one, two, three = got.collect()
    want = rows.agg(F.percentile("price_million_vnd", F.array(*map(F.lit, profile.QUANTILES.values())))).first()[0]
    assert [one[p] for p in profile.QUANTILES] == pytest.approx(want, rel=1e-12) and one["count"] == 5_000
    assert two["p50"] is None and three["count"] == 0
