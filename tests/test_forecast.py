"""Scores, model choice and forecast points."""

import datetime as dt
import math

import numpy as np
import pytest

from demandloom.functions import fits
from demandloom.functions.baseline import baseline_value
from demandloom.functions.dates import horizon
from demandloom.functions.scores import mae, mape
from demandloom.operators import forecast, history, reports
from pyspark.sql import functions as F

START = dt.date(2024, 1, 1)
SERIES = {"n0": [], "n1": [5], "n3": [1, 2, 3], "n4": [1, 2, 3, 4], "n5": [4, 8, 4, 8, 4], "n7": [3, 1, 4, 1, 5, 9, 2],
          "n8": [2, 7, 1, 8, 2, 8, 1, 8], "flat": [6] * 12, "line": list(range(1, 15)), "zero": [0] * 9}


@pytest.fixture(scope="module")
def packed(spark):
    rows = [(sku, START + dt.timedelta(days=i), float(q)) for sku, qs in SERIES.items() for i, q in enumerate(qs)]
    daily = spark.createDataFrame(rows, "sku string, date date, quantity double")
    requested = history.requested_skus(spark, list(SERIES))
    return history.pack_series(daily, requested)


def numpy_baseline(base, h):
    i = np.arange(h)
    s = 2.5 * np.pi * i / h
    t = np.linspace(-0.08, 0.08, h)
    return np.maximum(base * (1 + 0.12 * np.sin(s) + t) + 0.05 * base * np.sin(1.7 * s), 0)


@pytest.mark.parametrize("base, h", [(100.0, 1), (100.0, 2), (42.5, 30), (0.0, 5), (-3.0, 4)])
def test_baseline(spark, base, h):
    rows = spark.range(h).select(baseline_value(F.lit(base), F.col("id"), F.lit(h)).alias("v")).collect()
    assert [r.v for r in rows] == pytest.approx(list(numpy_baseline(base, h)), abs=1e-10)
    if (base, h) == (100.0, 1):
        assert rows[0].v == 92.0


@pytest.mark.parametrize(
    "actual, predicted, want_mape, want_mae",
    [([2.0, 4.0], [1.0, 5.0], 0.375, 1.0), ([0.0, 4.0], [1.0, 5.0], 0.25, 1.0), ([0.0], [3.0], math.inf, 3.0),
     ([], [], math.inf, math.inf), ([1.0], None, None, None)],
)
def test_scores(spark, actual, predicted, want_mape, want_mae):
    df = spark.createDataFrame([(actual, predicted)], "a array<double>, p array<double>")
    assert tuple(df.select(mape(F.col("a"), F.col("p")), mae(F.col("a"), F.col("p"))).first()) == (want_mape, want_mae)


def test_holdout_sizes(packed):
    got = {r.sku: (r.n_val, r.train, r.holdout) for r in forecast.split_holdout(packed).collect()}
    assert got["n3"] == (None, None, None) and got["n0"][0] is None
    assert got["n4"] == (1, [1, 2, 3], [4])
    assert got["n8"] == (2, [2, 7, 1, 8, 2, 8], [1, 8])
    assert got["line"][0] == 3 and got["line"][2] == [12, 13, 14]


@pytest.fixture(scope="module")
def fitted(packed):
    return {r.sku: r for r in forecast.fit_models(packed, horizon("2024-02-01", "2024-02-05")).collect()}


def test_short_series_fall_back_to_the_baseline(fitted):
    for sku in ("n0", "n1", "n3", "n4"):
        assert fitted[sku].model == "stub" and fitted[sku].path is None
        assert fitted[sku].arima_mape is None
    assert fitted["n0"].base == 100.0 and fitted["n3"].base == 2.0 and fitted["n0"].history == 0


def test_models_skip_what_is_too_short(fitted):
    assert fitted["n5"].arima_mape is not None and fitted["n5"].xgb_mape is None
    assert fitted["n7"].xgb_mape is not None


def test_least_mape_is_chosen_and_ties_go_to_arima(fitted):
    for r in fitted.values():
        scores = {m: r[f"{p}_mape"] for m, p in forecast.MODELS.items() if r[f"{p}_mape"] is not None}
        if scores:
            assert scores[r.model] == min(scores.values())
    assert fitted["flat"].model == "arima" and fitted["flat"].path == [6.0] * 5
    assert fitted["zero"].model == "arima" and fitted["zero"].arima_mape == math.inf


@pytest.mark.parametrize("model", ["arima", "prophet", "xgboost", "stub", "baseline"])
def test_forced_model(packed, model):
    rows = {r.sku: r for r in forecast.fit_models(packed, horizon("2024-02-01", "2024-02-05"), model).collect()}
    wanted = {"baseline": "stub"}.get(model, model)
    assert rows["line"].model == wanted
    assert rows["line"].arima_mape is not None  # scores are kept
    assert rows["n3"].model == "stub"
    assert rows["n4"].model == ("stub" if model in ("xgboost", "stub", "baseline") else wanted)


def test_unknown_or_auto_model_means_the_automatic_choice(packed, fitted):
    for name in ("auto", "nonsense", None, ""):
        assert forecast.forced_name(name) is None
    rows = forecast.fit_models(packed, horizon("2024-02-01", "2024-02-05"), "nonsense").collect()
    assert {r.sku: r.model for r in rows} == {sku: r.model for sku, r in fitted.items()}


def test_empty_horizon_gives_no_points_and_no_scores(packed):
    table = forecast.fit_models(packed, horizon("2024-02-05", "2024-02-01"))
    rows = table.collect()
    assert len(rows) == len(SERIES)
    assert all(r.model == "stub" and r.arima_mape is None for r in rows)
    assert forecast.forecast_points(table).count() == 0


def test_true_holdout_changes_only_the_seasonal_score(packed, fitted):
    rows = {r.sku: r for r in forecast.fit_models(packed, horizon("2024-02-01", "2024-02-05"), true_holdout=True).collect()}
    assert rows["line"].arima_mape == fitted["line"].arima_mape
    assert rows["line"].prophet_mape < fitted["line"].prophet_mape


def test_results_do_not_depend_on_partitions(spark, packed, fitted):
    again = {r.sku: r for r in forecast.fit_models(packed.repartition(1), horizon("2024-02-01", "2024-02-05")).collect()}
    for sku, r in fitted.items():
        assert again[sku].model == r.model
        assert again[sku].path == pytest.approx(r.path) if r.path else again[sku].path is None


def test_repeated_requests_repeat_points(spark, packed):
    fits = forecast.fit_baseline(packed, horizon("2024-02-01", "2024-02-03"))
    requested = history.requested_skus(spark, ["n1", "n0", "n1"])
    rows = sorted((r.seq, r.date, r.sku, r.mean) for r in forecast.forecast_points(fits, requested).collect())
    assert [r[2] for r in rows] == ["n1"] * 3 + ["n0"] * 3 + ["n1"] * 3
    assert [r[3] for r in rows[:3]] == pytest.approx(list(numpy_baseline(5.0, 3)))
    assert [r[3] for r in rows[3:6]] == pytest.approx(list(numpy_baseline(100.0, 3)))


def test_packed_and_direct_baseline_agree(spark):
    rows = [("a", START, 3.0), ("a", START + dt.timedelta(days=5), 6.0), ("b", START, 1.0)]
    daily = spark.createDataFrame(rows, "sku string, date date, quantity double")
    steps = horizon("2024-02-01", "2024-02-04")
    direct = forecast.baseline_points(daily, steps).collect()
    packed = forecast.forecast_points(forecast.fit_baseline(history.pack_series(daily), steps)).collect()
    assert sorted(map(tuple, direct)) == sorted(map(tuple, packed))


def test_metrics_have_the_code_for_every_sku(spark, packed, fitted):
    fits = forecast.fit_models(packed, horizon("2024-02-01", "2024-02-05"))
    values = {r.key: r.value for r in forecast.metrics(fits).collect()}
    assert values["n0.chosen_model"] == 0.0 and "n0.arima_mape" not in values
    assert values["flat.chosen_model"] == 1.0 and values["flat.arima_mape"] == 0.0
    code = fits.select(forecast.model_code(F.lit("other"))).first()[0]
    assert code == -1.0


def scored(spark, *rows):
    names = ["arima_mape", "arima_mae", "prophet_mape", "prophet_mae", "xgb_mape", "xgb_mae"]
    schema = "sku string, model string, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, schema)


def test_best_scores_skip_missing_and_infinite_values(spark):
    inf = math.inf
    df = scored(
        spark, ("tie", "x", 0.2, 1.0, 0.2, 2.0, 0.3, 3.0), ("inf", "x", inf, 1.0, inf, 2.0, 0.9, 3.0),
        ("none", "x", inf, 1.0, inf, 2.0, inf, 3.0), ("some", "x", None, None, 0.4, 4.0, 0.1, 9.0),
    )
    got = {r.sku: (r.mape, r.mae) for r in reports.best_scores(df).collect()}
    assert got == {"tie": (0.2, 1.0), "inf": (0.9, 3.0), "none": (None, None), "some": (0.1, 9.0)}
    chosen = {r.sku: r.m for r in df.select("sku", forecast.best_model()["model"].alias("m")).collect()}
    assert chosen == {"tie": "arima", "inf": "xgboost", "none": "arima", "some": "xgboost"}


def test_only_the_fits_run_in_python_and_sales_shuffle_twice(spark, small):
    from demandloom.sources.star_views import StarViews

    daily = history.daily_demand(StarViews(spark, small).part_sales())
    fits = forecast.fit_models(history.pack_series(daily), horizon("2024-02-01", "2024-02-05"))
    plan = fits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2
    assert plan.count("Exchange hashpartitioning") == 2
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in plan


def test_automatic_choice_step_by_step(packed, fitted):
    """The whole path again for single series: split, three fits, scores, choice, final fit."""
    ahead = np.array([(dt.date(2024, 2, d) - dt.date(1970, 1, 1)).days for d in range(1, 6)], dtype=float)
    for r in packed.collect():
        y = np.array(r.quantities)
        days = np.array([(d - dt.date(1970, 1, 1)).days for d in r.dates], dtype=float)
        if len(y) < 4:
            continue
        n_val = min(3, max(1, len(y) // 4))
        train, held = y[:-n_val], y[-n_val:]
        guess_days = days[:-n_val][-n_val] + np.arange(n_val)
        tried = {
            "arima": fits.arima_paths([train], [n_val])[0],
            "prophet": fits.seasonal_paths([days[:-n_val]], [train], [guess_days])[0],
            "xgboost": fits.boosted_paths([train], [n_val])[0],
        }
        scores = {}
        for model, path in tried.items():
            if path is not None:
                above = held > 0
                errors = np.abs(held - path)
                scores[model] = (np.mean(errors[above] / held[above]) if above.any() else math.inf, errors.mean())
        got = fitted[r.sku]
        for model, prefix in forecast.MODELS.items():
            pair = (got[f"{prefix}_mape"], got[f"{prefix}_mae"])
            assert pair == pytest.approx(scores[model], rel=1e-9) if model in scores else pair == (None, None)
        if not scores:
            assert got.model == "stub"
            continue
        best = min(scores, key=lambda m: scores[m][0])
        final = {
            "arima": lambda: fits.arima_paths([y], [5]),
            "prophet": lambda: fits.seasonal_paths([days], [y], [ahead]),
            "xgboost": lambda: fits.boosted_paths([y], [5]),
        }[best]()[0]
        assert got.model == best and got.path == pytest.approx(list(final), rel=1e-9)
