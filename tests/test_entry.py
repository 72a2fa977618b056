from __future__ import annotations

import decimal

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    """Numbers of all types alike; everything else, dates and timestamps among them, as it is."""
    number = isinstance(value, (int, float, decimal.Decimal)) and not isinstance(value, bool)
    return "null" if value is None or value != value else f"{float(value):.10g}" if number else str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[k] for k in order], sorted(tuple(shown(r[k]) for k in order) for r in found)


def test_names():
    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found)
    if any(q.startswith("op1_") for q in found):
        assert [sum(q.startswith(f"op{n}_") for q in found) for n in range(1, 11)] == [1] * 10 and "pipeline" in found


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


FAST = [
    "market_mart", "staging_cast", "accent_strip", "fact_listings", "avm_mart", "feature_mart", "missing_summary", "corr_matrix_long",
    "skew_adjusted", "mart_reconcile_full_outer", "quality_metrics", "profile_stats", "profile_iqr", "profile_duplicates", "encoder_apply",
    "encoder_oof", "date_dim_sequence", "dedupe_latest", "linear_one_hot", "csv_load", "strict_copy", "table_replace", "add_missing_dates",
    "spaces_normalize", "location_cases", "gate_violations", "finite_values", "effect_range_or_null", "sample_size", "legacy_locations", "province_medians_distributed",
    "province_refs", "encoder_fit_province"
]


@pytest.mark.parametrize("name", FAST)
def test_like_sql(spark, data, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    mine, other = entry.queries()[name](spark, data), db.sql(entry.oracle_sql()[name])
    assert rows(mine.columns, mine.collect()) == rows(other.columns, other.fetchall())


@pytest.mark.parametrize("name", ["global_quantiles", "iqr_flags"])
def test_price_queries(spark, data, name, monkeypatch):
    """No reducer with every distinct value and, where the session has no fact yet, none with places; the rows are the SQL's."""
    monkeypatch.setattr(entry.warehouse, "_stored", {})
    plan = entry.queries()[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "province" not in plan
    test_like_sql(spark, data, name)
