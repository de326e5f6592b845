"""Profiles merged from sketches, against exact ones."""

import datetime as dt

import pytest

from demandloom.operators.profile import dataset_profile, merged_profile, profile_sketch

SALES = "date date, sku string, location string, quantity double"


def upload(spark, low, high):
    return spark.range(low, high).selectExpr(
        "date_add(date'2024-01-01', cast(id % 90 as int)) AS date", "concat('S', id) AS sku", "concat('L', id % 7) AS location", "1D AS quantity"
    )


def test_overlapping_uploads(spark):
    parts = [upload(spark, 0, 30_000), upload(spark, 20_000, 60_000), upload(spark, 0, 10)]
    sketches = profile_sketch(parts[0]).union(profile_sketch(parts[1])).union(profile_sketch(parts[2]))
    got = merged_profile(sketches).first()
    assert (got.uploads, got.rows, got.locations) == (3, 70_010, 7)
    assert got.skus == pytest.approx(60_000, rel=0.03)
    assert (got.first_date, got.last_date) == (dt.date(2024, 1, 1), dt.date(2024, 3, 30))
    assert max(len(r.skus) for r in sketches.collect()) < 10_000


def test_agrees_with_the_exact_profile_where_keys_are_few(spark):
    df = upload(spark, 0, 500)
    exact, got = dataset_profile(df).first(), merged_profile(profile_sketch(df)).first()
    assert (got.rows, got.skus, got.locations, got.first_date, got.last_date) == (exact.rows, exact.skus, exact.locations, exact.first_date, exact.last_date)


def test_missing_columns_nulls_and_unreadable_dates(spark):
    text = spark.createDataFrame([("2024-01-01", "A"), ("soon", None), (None, "B")], "date string, sku string")
    both = profile_sketch(text).union(profile_sketch(upload(spark, 0, 3)))
    got = merged_profile(both).first()
    assert (got.rows, got.skus, got.locations, got.first_date) == (6, 5, 3, None)
    none = merged_profile(profile_sketch(spark.createDataFrame([], SALES))).first()
    assert (none.rows, none.skus, none.first_date) == (0, 0, None)


def test_the_exact_profile_counts_nulls_nowhere_and_uses_no_window(spark):
    rows = [(None, "A", "L", 1.0), (dt.date(2024, 1, 1), "A", "M", 1.0), (dt.date(2024, 1, 2), None, "M", 1.0), (None, "B", None, 1.0)]
    df = dataset_profile(spark.createDataFrame(rows, SALES))
    row = df.first()
    assert (row.rows, row.skus, row.locations, row.first_date, row.last_date) == (4, 2, 2, dt.date(2024, 1, 1), dt.date(2024, 1, 2))
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
