"""Weekly and monthly history."""

import datetime as dt

import pandas as pd
import pytest

from demandloom.operators.history import resample, whole_periods
from demandloom.plans.flow import forecast_fits
from demandloom.plans.requests import ForecastRequest

DAILY = "sku string, date date, quantity double"


def day(text):
    return dt.date.fromisoformat(text)


def listed(df):
    return sorted(map(tuple, df.collect()))


def test_weeks_and_their_partial_ends(spark):
    # 2024-01-01 is a Monday.
    rows = [("A", "2024-01-03", 1.0), ("A", "2024-01-07", 2.0), ("A", "2024-01-08", 4.0), ("A", "2024-01-23", 8.0), ("B", "2024-01-01", 1.0), ("B", "2024-01-07", 1.0)]
    daily = spark.createDataFrame([(s, day(d), q) for s, d, q in rows], DAILY)
    assert listed(resample(daily, "W")) == [
        ("A", day("2024-01-07"), 3.0, True), ("A", day("2024-01-14"), 4.0, False), ("A", day("2024-01-21"), 0.0, False), ("A", day("2024-01-28"), 8.0, True),
        ("B", day("2024-01-07"), 2.0, False),
    ]
    assert listed(whole_periods(resample(daily, "W"))) == [("A", day("2024-01-14"), 4.0), ("A", day("2024-01-21"), 0.0), ("B", day("2024-01-07"), 2.0)]


def test_months_and_single_partial_ones(spark):
    rows = [("A", "2024-01-01", 1.0), ("A", "2024-02-29", 2.0), ("B", "2023-11-05", 3.0), ("B", "2024-02-01", 1.0), ("C", "2024-02-10", 5.0)]
    daily = spark.createDataFrame([(s, day(d), q) for s, d, q in rows] + [("A", None, 9.0)], DAILY)
    assert listed(resample(daily, "M")) == [
        ("A", day("2024-01-31"), 1.0, False), ("A", day("2024-02-29"), 2.0, False),
        ("B", day("2023-11-30"), 3.0, True), ("B", day("2023-12-31"), 0.0, False), ("B", day("2024-01-31"), 0.0, False), ("B", day("2024-02-29"), 1.0, True),
        ("C", day("2024-02-29"), 5.0, True),
    ]
    # C has no whole month, so its partial one is all there is to know.
    assert {r.sku for r in whole_periods(resample(daily, "M")).collect()} == {"A", "B", "C"}


@pytest.mark.parametrize("granularity, rule", [("W", "W-SUN"), ("M", "ME")])
def test_sums_agree_with_pandas(spark, granularity, rule):
    days = pd.date_range("2023-03-08", periods=400, freq="D")
    values = [float(i * 7 % 23) for i in range(400)]
    keep = [i for i in range(400) if i % 11 and not 100 < i < 170]
    daily = spark.createDataFrame([("A", days[i].date(), values[i]) for i in keep], DAILY)
    want = pd.Series([values[i] for i in keep], index=days[keep]).resample(rule).sum()
    got = {r.date: r.quantity for r in resample(daily, granularity).collect()}
    assert got == {d.date(): q for d, q in want.items()}


def test_other_granularities_and_empty_history(spark):
    empty = spark.createDataFrame([], DAILY)
    assert resample(empty, "W").collect() == []
    with pytest.raises(ValueError):
        resample(empty, "D")


def test_one_exchange_by_sku(spark):
    df = resample(spark.createDataFrame([("A", day("2024-01-03"), 1.0)], DAILY), "M")
    df.collect()
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_a_weekly_forecast_continues_weekly_history(spark):
    rows = [(day("2024-01-01") + dt.timedelta(days=i), "A", "L", 10.0) for i in range(70)] + [(day("2024-01-05"), "S", "L", 7.0)]
    sales = spark.createDataFrame(rows, "date date, sku string, location string, quantity double")
    asked = dict(start_date="2024-03-11", end_date="2024-04-01", granularity="W", forced_model="stub")
    for whole, base, history in ((False, 10.0, 70), (True, 70.0, 10)):
        fits, _ = forecast_fits(sales, ForecastRequest(**asked, resample=whole))
        found = {r.sku: (r.base, r.history, len(r.horizon)) for r in fits.collect()}
        assert found["A"] == (base, history, 3) and found["S"] == (7.0, 1, 3)
    fits, _ = forecast_fits(sales, ForecastRequest(**{**asked, "granularity": "D"}, resample=True))
    assert {r.sku: r.history for r in fits.collect()} == {"A": 70, "S": 1}
