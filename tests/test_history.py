"""Signals, daily demand, horizons."""

import datetime as dt

import pandas as pd
import pytest

from demandloom.functions.dates import horizon, parse_date
from demandloom.operators import enrich, history, monitor
from pyspark.sql import functions as F

D1, D2, D3 = (dt.date(2024, 1, d) for d in (1, 2, 3))
SALES = "date date, sku string, location string, quantity double"


@pytest.fixture
def sales(spark):
    rows = [(D1, "a", "L1", 1.0), (D1, "a", "L2", 2.0), (D1, "a", "L1", 4.0), (D2, "a", "L2", None), (D2, "b", "L2", 8.0),
            (None, "a", "L1", 16.0), (D3, None, "L1", 32.0), (D3, "b", None, 64.0)]
    return spark.createDataFrame(rows, SALES)


def daily(df):
    return {(r.sku, r.date): r.quantity for r in df.collect()}


def test_daily_demand_drops_missing_keys_and_counts_missing_quantities_as_zero(sales):
    assert daily(history.daily_demand(sales)) == {("a", D1): 7.0, ("a", D2): 0.0, ("b", D2): 8.0, ("b", D3): 64.0}


def test_location_falls_back_per_sku(sales):
    got = daily(history.daily_demand(sales, location="L1"))
    assert got == {("a", D1): 5.0, ("b", D2): 8.0, ("b", D3): 64.0}


def test_location_seen_only_without_a_date_leaves_no_history(spark):
    df = spark.createDataFrame([(None, "a", "L1", 1.0), (D1, "a", "L2", 2.0)], SALES)
    assert daily(history.daily_demand(df, location="L1")) == {}


def test_repeated_signals_multiply_demand(spark, sales):
    signals = spark.createDataFrame([(D1, "L1"), (D1, "L1"), (D3, None), (D3, None), (D3, None)], "date date, location string")
    got = daily(history.daily_demand(sales, signals))
    assert got == {("a", D1): 12.0, ("a", D2): 0.0, ("b", D2): 8.0, ("b", D3): 192.0}
    joined = enrich.attach_signals(sales, signals).groupBy("sku", "date").agg(F.sum("quantity").alias("quantity"))
    assert {k: v for k, v in daily(joined).items() if None not in k and v} == {k: v for k, v in got.items() if v}
    assert {(r.date, r.location, r.copies) for r in enrich.repeated_signal_keys(signals).collect()} == {(D1, "L1", 2), (D3, None, 3)}


def test_requested_skus_without_history_get_empty_series(spark, sales):
    requested = history.requested_skus(spark, ["a", "zz", "a"])
    series = {r.sku: r for r in history.pack_series(history.daily_demand(sales, requested=requested), requested).collect()}
    assert set(series) == {"a", "zz"}
    assert series["a"].dates == [D1, D2] and series["a"].quantities == [7.0, 0.0]
    assert series["zz"].dates == [] and series["zz"].quantities == []


def test_signals_match_missing_locations_and_keep_all_sales(spark, sales):
    signals = spark.createDataFrame([(D3, None, 9.0), (D1, "L1", 3.0)], "date date, location string, temperature double")
    rows = enrich.attach_signals(sales, signals).collect()
    assert len(rows) == 8
    assert {(r.sku, r.temperature) for r in rows if r.temperature} == {("a", 3.0), ("b", 9.0)}


def test_fill_uses_the_mean_over_joined_sales(spark, sales):
    signals = spark.createDataFrame(
        [(D1, "L1", None, 10.0, None), (D1, "L2", 1, 40.0, None)],
        "date date, location string, is_holiday int, temperature double, price double",
    )
    rows = enrich.sales_with_signals(sales, signals).collect()
    # Two sales rows meet 10 and one meets 40.
    assert {r.temperature for r in rows if r.date == D2} == {20.0}
    assert {r.is_holiday for r in rows if r.location == "L1"} == {0}
    assert all(r.price is None for r in rows)


def test_columns_on_both_sides_get_suffixes_and_no_fill(spark, sales):
    priced = sales.withColumn("price", F.lit(None).cast("double"))
    signals = spark.createDataFrame([(D1, "L1", 5.0)], "date date, location string, price double")
    out = enrich.sales_with_signals(priced, signals)
    assert "price_x" in out.columns and "price_y" in out.columns
    assert out.where("price_y IS NULL").count() == 6


def test_signal_column_of_the_sales_table_is_filled_with_its_own_mean(spark, sales):
    priced = sales.withColumn("price", F.when(F.col("sku") == "b", F.col("quantity")))
    signals = spark.createDataFrame([(D3, None), (D3, None)], "date date, location string")
    rows = enrich.sales_with_signals(priced, signals).collect()
    # b sold at 8 once and at 64, which meets two signals, twice.
    assert {round(r.price, 6) for r in rows if r.sku == "a"} == {round((8 + 64 + 64) / 3, 6)}


@pytest.mark.parametrize("granularity", ["D", "W", "M"])
@pytest.mark.parametrize(
    "start, end",
    [("2024-01-01", "2024-03-31"), ("2023-12-30", "2024-01-01"), ("2024-02-29", "2024-02-29"), ("2024-01-02", "2024-01-01"), ("2024-01-07", "2024-01-07")],
)
def test_horizon_matches_pandas(spark, start, end, granularity):
    got = spark.range(1).select(horizon(start, end, granularity)).first()[0]
    freq = {"M": "ME"}.get(granularity, granularity)
    assert got == [d.date() for d in pd.date_range(start, end, freq=freq)]


def test_horizon_checks_granularity():
    with pytest.raises(ValueError):
        horizon("2024-01-01", "2024-01-02", "Y")


@pytest.mark.parametrize(
    "text, wanted",
    [("2024-03-04", (2024, 3, 4)), ("2024-03-04 10:11:12", (2024, 3, 4)), ("2024-03-04T10:11:12", (2024, 3, 4)),
     ("3/4/2024", (2024, 3, 4)), ("03/04/2024 0:00", (2024, 3, 4)), ("2024/3/4", (2024, 3, 4)), ("4-Mar-2024", (2024, 3, 4)),
     ("3/4/24", (2024, 3, 4)), ("3/4/99", (1999, 3, 4)), ("12/31/68", (2068, 12, 31)), ("20240304", (2024, 3, 4)), ("3-4-2024", (2024, 3, 4)),
     ("4.3.2024", (2024, 3, 4)), ("4.3.24", (2024, 3, 4)), ("Mar 4, 2024", (2024, 3, 4)), ("MAR 4, 2024", (2024, 3, 4)), ("4-mar-24", (2024, 3, 4)),
     ("3/4/2024 1:05 PM", (2024, 3, 4)), ("3/4/2024 1:05:09 am", (2024, 3, 4)), ("20241340", None), ("31.02.2024", None), ("123", None),
     ("13/14/2024", None), ("n/a", None), (" 2024-03-04 ", (2024, 3, 4))],
)
def test_parse_date(spark, text, wanted):
    got = spark.createDataFrame([(text,)], "t string").select(parse_date(F.col("t"))).first()[0]
    assert got == (wanted and dt.date(*wanted))


def test_naive_mape_by_hand(spark):
    df = spark.createDataFrame([(D1, "a", "L", 1.0), (D1, "b", "L", 1.0), (D2, "a", "L", 4.0), (D3, None, "L", 0.0)], SALES)
    row = monitor.naive_mape(df).first()
    assert row.baseline == 2.0 and row.mape == pytest.approx((0 + 2 / 4 + 2 / 1) / 3)
    assert monitor.train_naive_mean(df).first().artifact == "baseline_mean=2.0"
