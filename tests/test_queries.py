"""Every query against its SQL, and the shape of the queries that have none."""

import math

import pytest

import __spark_entry__ as entry
from oracle import database, differences


@pytest.fixture(scope="module")
def con(small):
    return database(small)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, small, con, name):
    assert differences(spark, con, small, name) == ""


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_plans_every_part(spark):
    plan = entry.entry(spark)
    assert plan.columns == ["sku", "line", "location", "date", "quantity"]
    assert plan.count() == 2 * plan.select("sku").distinct().count() > 0


@pytest.mark.parametrize("name, skus", [("auto_forecast", 25), ("auto_forecast_parts", 200)])
def test_auto_forecast_covers_every_day(spark, small, name, skus):
    rows = entry.queries()[name](spark, small).collect()
    assert len(rows) == skus * 30
    assert all(r.mean >= 0 and math.isfinite(r.mean) for r in rows)
    assert all(math.isclose(r.q10, 0.8 * r.mean) and r.q50 == r.mean for r in rows)


def test_auto_metrics_choose_the_least_mape(spark, small):
    values = {}
    for r in entry.queries()["auto_metrics"](spark, small).collect():
        sku, metric = r.key.split(".")
        values.setdefault(sku, {})[metric] = r.value
    assert len(values) == 25
    for v in values.values():
        mapes = [v["arima_mape"], v["prophet_mape"], v["xgb_mape"]]
        assert v["chosen_model"] == 1 + mapes.index(min(mapes))


def test_auto_plan_follows_the_forecast(spark, small):
    points = entry.queries()["auto_forecast"](spark, small).toPandas()
    plan = entry.queries()["auto_plan"](spark, small).toPandas().set_index("sku")
    demand = points.groupby("sku")["mean"].sum()
    assert len(plan) == 25
    for sku, total in demand.items():
        assert math.isclose(plan.loc[sku, "demand"], total, rel_tol=1e-9)
        assert math.isclose(plan.loc[sku, "required"], total * (1 + 1.65 * 10 / 30), rel_tol=1e-9)
