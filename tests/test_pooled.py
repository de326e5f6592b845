"""Trees over all SKUs: rows, rules of the recursion, and the fit table that uses them."""

import datetime as dt
import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from demandloom.functions.dates import horizon
from demandloom.operators import pooled
from demandloom.operators.forecast import fit_models
from demandloom.plans.flow import PlanningFlow
from demandloom.plans.requests import ForecastRequest

SERIES = "sku string, dates array<date>, quantities array<double>"
DAY = dt.date(2024, 1, 1)


def series(spark, rows):
    return spark.createDataFrame([(s, [DAY + dt.timedelta(days=i) for i in range(len(q))], [float(x) for x in q]) for s, q in rows.items()], SERIES)


@pytest.fixture(scope="module")
def many(spark):
    rows = {f"s{k}": [(10 + k) * (2 if i % 2 else 1) for i in range(8 + k % 9)] for k in range(40)}
    return series(spark, rows | {"short": [1, 2, 3, 4, 5], "none": [], "zero": [0] * 9, "falling": [-5, -1, -3, -2, -9, -4]})


@pytest.fixture(scope="module")
def trees(many):
    return pooled.fit_pooled(many)


def test_lag_rows_are_shares_of_the_mean(spark):
    rows = pooled.lag_rows(series(spark, {"a": [1, 2, 3, 4, 5, 9], "b": [1] * 5, "z": [0] * 6})).collect()
    a = [(r.date, r.previous, r.value) for r in rows if r.sku == "a"]
    assert a == [(DAY + dt.timedelta(days=i + 1), q / 4, n / 4) for i, (q, n) in enumerate(zip([1, 2, 3, 4, 5], [2, 3, 4, 5, 9]))]
    assert {r.sku for r in rows} == {"a", "z"} and all(r.value == 0 for r in rows if r.sku == "z")


def test_the_step_function_is_the_model(spark, many, monkeypatch):
    """The cuts and values against MLlib's own predictions, at, between and beyond the cuts."""
    kept = []
    original = pooled.PooledTrees.of
    monkeypatch.setattr(pooled.PooledTrees, "of", lambda model: kept.append(model) or original(model))
    found = pooled.fit_pooled(many)
    at = sorted({x for c in found.cuts for x in (c, c - 1e-9, c + 1e-9)} | {-5.0, 0.0, 1e6})
    got = [r.v for r in spark.createDataFrame([(x,) for x in at], "x double").select(found.value(F.col("x")).alias("v")).collect()]
    assert got == pytest.approx([kept[0].predict(Vectors.dense(x)) for x in at])
    assert 0 < len(found.cuts) <= pooled.TREES * 3 and len(found.values) == len(found.cuts) + 1


def test_recursion_clips_and_feeds_back(many, trees):
    def value(x):
        return trees.values[sum(c < x for c in trees.cuts)]

    for r in many.withColumn("path", trees.path(F.col("quantities"), F.lit(7))).collect():
        if len(r.quantities) < pooled.LEAST_POINTS:
            assert r.path is None
            continue
        mean = sum(r.quantities) / len(r.quantities)
        size = mean if mean > 0 else 1.0
        last, want = r.quantities[-1] / size, []
        for _ in range(7):
            last = max(value(last), 0.0)
            want.append(last * size)
        assert r.path == pytest.approx(want) and min(r.path) >= 0


def test_negative_steps_are_clipped_before_they_are_fed_back(many):
    down = pooled.PooledTrees((0.5,), (3.0, -2.0))
    path = many.where("sku = 's0'").select(down.path(F.col("quantities"), F.lit(3)).alias("p")).first().p
    mean = 15.0
    assert path == pytest.approx([0.0, 3 * mean, 0.0])


def test_the_trees_learn_the_alternation(many, trees):
    for r in many.where("sku LIKE 's%' AND size(quantities) > 6").withColumn("path", trees.path(F.col("quantities"), F.lit(4))).collect():
        if r.sku[1:].isdigit():
            low, high = min(r.quantities), max(r.quantities)
            first, second = (low, high) if r.quantities[-1] == high else (high, low)
            assert r.path == pytest.approx([first, second] * 2, rel=0.15)


def test_cells_hold_every_row(many):
    rows, cuts = pooled.lag_rows(many).withColumn("group", F.dayofmonth("date") % 3), [0.5, 0.7, 1.0]
    want = {}
    for r in rows.collect():
        want.setdefault(sum(c <= r.previous for c in cuts), []).append(r.value)
    found = pooled.cells(rows, cuts).collect()
    assert len(found) <= 3 * len(want) < rows.count()
    for b, values in want.items():
        mine = [c for c in found if c.bin == b]
        assert sum(c.weight for c in mine) == len(values)
        assert sum(c.weight * c.value for c in mine) == pytest.approx(sum(values))


def test_trees_from_cells_are_those_from_rows(spark, monkeypatch):
    """Without samples both see the same sums, so they predict the same; MLlib gets cells only."""
    rng = random.Random(5)
    shuffled = series(spark, {f"s{k}": rng.sample(range(1, 10), 9) for k in range(40)})
    monkeypatch.setattr(pooled, "SHARE", 1.0)
    from_rows, got = pooled.fit_pooled(shuffled, trees=9), []
    monkeypatch.setattr(pooled, "ROWS", 0)
    monkeypatch.setattr(pooled, "GROUPS", 2)
    monkeypatch.setattr(pooled, "_vectors", lambda rows, name, plain=pooled._vectors: got.append(rows.count()) or plain(rows, name))
    from_cells = pooled.fit_pooled(shuffled, trees=9)
    at = spark.createDataFrame([(q / 5,) for q in range(1, 10)], "x double")
    for r in at.select(from_rows.value(F.col("x")).alias("rows"), from_cells.value(F.col("x")).alias("cells")).collect():
        assert r.cells == pytest.approx(r.rows)
    assert got == [18]


def test_no_usable_series(spark):
    assert pooled.fit_pooled(series(spark, {"a": [1, 2]})) is None
    steps = horizon("2024-03-01", "2024-03-03")
    rows = fit_models(series(spark, {"a": [1, 2]}), steps, "xgboost", pooled=True).collect()
    assert [(r.model, r.path) for r in rows] == [("stub", None)]
    one = pooled.fit_pooled(series(spark, {"c": [5] * 8}))
    assert one.cuts == () and one.values == pytest.approx((1.0,))


def test_the_fit_table_uses_them(many, trees):
    steps = horizon("2024-03-01", "2024-03-05")
    fits = {r.sku: r for r in fit_models(many, steps, "xgboost", pooled=True).collect()}
    want = {r.sku: r.path for r in many.withColumn("path", trees.path(F.col("quantities"), F.lit(5))).collect()}
    for sku, r in fits.items():
        assert (r.model == "xgboost") == (want[sku] is not None)
        assert r.path is None if want[sku] is None else r.path == pytest.approx(want[sku])
        assert (r.xgb_mape is not None) == (r.history - min(3, max(1, r.history // 4)) >= 6)


def test_only_trees_come_to_the_driver(many, trees):
    plan = many.select(trees.path(F.col("quantities"), F.lit(5)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_a_request_for_pooled_trees(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    lines = [f"2024-01-{d:02d},{sku},{q + d % 2}" for sku, q in (("A", 4), ("B", 40)) for d in range(1, 21)]
    (data / "sample_sales.csv").write_text("date,sku,qty\n" + "\n".join(lines) + "\n")
    (data / "sample_external_signals.csv").write_text("date,location\n2024-01-01,L\n")
    flow = PlanningFlow(spark, str(data), str(tmp_path / "results"))
    forecast_id = flow.create_forecast(ForecastRequest(dt.date(2024, 1, 21), dt.date(2024, 1, 23), forced_model="xgboost", pooled_trees=True))
    points = {(r.sku, r.date.day): r["mean"] for r in flow.points(forecast_id).collect()}
    assert {r.model for r in flow.fits(forecast_id).collect()} == {"xgboost"} and len(points) == 6
    assert points["B", 21] == pytest.approx(41, rel=0.1) and points["A", 21] == pytest.approx(5, rel=0.15)
