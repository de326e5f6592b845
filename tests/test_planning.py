"""Supply plan, scenarios, explanation and reports."""

import datetime as dt
import math

import pytest

from demandloom.functions.text import fixed, grouped_whole
from demandloom.operators import explain, reports, scenario, supply
from pyspark.sql import functions as F

D1, D3 = dt.date(2024, 1, 1), dt.date(2024, 1, 3)
POINTS = "sku string, date date, mean double, q10 double, q90 double"


@pytest.fixture
def points(spark):
    rows = [("a", D1, 30.0, 24.0, 36.0), ("b", D3, 60.0, 48.0, 72.0), ("c", D1, 0.0, 0.0, 0.0)]
    return spark.createDataFrame(rows, POINTS)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], POINTS)


def by_sku(df):
    return {r.sku: r for r in df.collect()}


def test_horizon_is_that_of_all_skus(points):
    got = by_sku(supply.demand_summary(points))
    assert {r.horizon_days for r in got.values()} == {3} and got["b"].first_date == D1


def test_plan_by_hand(points):
    required = supply.requirements(supply.demand_summary(points), 0.95, 6)
    got = by_sku(required)
    assert got["a"].safety_stock == pytest.approx(30 / 3 * 6 * 1.65)
    assert by_sku(supply.requirements(supply.demand_summary(points), 0.9, 6))["a"].safety_stock == pytest.approx(60.0)
    orders, made = by_sku(supply.orders(required, "W")), by_sku(supply.production(required))
    assert set(orders) == set(made) == {"a", "b"}
    assert orders["a"].quantity == pytest.approx(0.4 * 129) and made["a"].quantity == pytest.approx(0.6 * 129)
    assert (orders["b"].order_date, orders["b"].location, orders["b"].order_type) == (D1, "W", "purchase")
    assert (made["b"].production_date, made["b"].line_id) == (D1, "LINE-1")
    kpis = [tuple(r)[1:] for r in supply.plan_kpis(required, 0.95).orderBy("position").collect()]
    assert kpis[0][0] == "Total Volume" and kpis[0][1] == pytest.approx(90 * 4.3) and kpis[0][2] == "units"
    assert kpis[1] == ("Target Service Level", 0.95, "")


def test_constraints_per_sku(spark, points):
    limits = spark.createDataFrame([("a", 0.5, 3)], "sku string, target_service_level double, lead_time_days int")
    got = by_sku(supply.requirements(supply.demand_summary(points), 0.95, 6, limits))
    assert got["a"].safety_stock == pytest.approx(30.0) and got["b"].safety_stock == pytest.approx(60 / 3 * 6 * 1.65)


def test_known_span_gives_the_same_plan(points):
    span = F.struct(F.to_date(F.lit("2024-01-01")).alias("first"), F.to_date(F.lit("2024-01-03")).alias("last"))
    assert by_sku(supply.demand_summary(points, span)) == by_sku(supply.demand_summary(points))


def test_no_points_no_plan(nothing):
    required = supply.requirements(supply.demand_summary(nothing))
    assert supply.orders(required).count() == supply.production(required).count() == supply.plan_kpis(required).count() == 0


# --- scenarios

SCENARIO = "scenario_id string, forecast_id string, plan_id string, name string, seq int"


@pytest.fixture
def plans(spark):
    return spark.createDataFrame([("p2", "f1", 2), ("p1", "f1", 1), ("p0", "f2", 0)], "plan_id string, forecast_id string, seq int")


def test_base_plan_lookup(spark, plans):
    asked = spark.createDataFrame(
        [("own", "f1", "p2", None, 0), ("first", "f1", None, None, 1), ("blank", "f1", "", None, 2), ("wrong", "f1", "zz", None, 3),
         ("none", "f9", None, None, 4), ("other", "f1", "p0", None, 5)], SCENARIO)
    got = {r.scenario_id: (r.base_plan_id, r.status) for r in scenario.base_plans(asked, plans).collect()}
    assert got == {
        "own": ("p2", "ok"), "first": ("p1", "ok"), "blank": ("p1", "ok"), "wrong": (None, "plan_not_found"),
        "none": (None, "no_base_plan"), "other": ("p0", "ok"),
    }


def test_scenario_kpis_and_narratives(spark, plans):
    asked = spark.createDataFrame(
        [("up", "f1", "p1", "Promo", 0), ("mean", "f1", "p1", "", 1), ("calm", "f1", "p1", None, 2), ("zero", "f2", "p0", None, 3)], SCENARIO)
    shocks = spark.createDataFrame(
        [("up", "demand", 1.2), ("mean", "demand", 1.2), ("mean", "demand", 0.6), ("calm", "supply", 3.0), ("zero", "demand", 2.0)],
        "scenario_id string, type string, factor double")
    lines = spark.createDataFrame([("p1", 400.0), ("p2", 7.0)], "plan_id string, quantity double")
    made = spark.createDataFrame([("p1", 600.0)], "plan_id string, quantity double")
    kpis = scenario.scenario_kpis(scenario.base_plans(asked, plans), scenario.plan_volumes(lines, made), shocks)
    got = {r.scenario_id: r for r in scenario.narratives(scenario.delta_percent(kpis)).collect()}
    assert (got["up"].base, got["up"].scenario) == (1000.0, 1200.0) and got["up"].delta_percent == pytest.approx(20.0)
    assert got["mean"].scenario == pytest.approx(900.0) and got["calm"].delta == 0.0
    assert got["zero"].delta_percent is None
    assert got["up"].narrative == (
        "Promo: Total volume increase from 1000 to 1200 units (+20.0%). Average demand factor applied across shocks: x1.20."
    )
    assert got["mean"].narrative.startswith("Scenario: Total volume decrease from 1000 to 900 units (-10.0%).")
    assert got["calm"].narrative == "Scenario: Total volume no change from 1000 to 1000 units (+0.0%)."
    assert got["zero"].narrative == (
        "Scenario: Total volume no change from 0 to 0 units (+0.0%). Average demand factor applied across shocks: x2.00."
    )
    texts = {r.scenario_id: r.text for r in reports.scenario_text(scenario.narratives(kpis).withColumn(
        "narrative", F.when(F.col("scenario_id") != "calm", F.col("narrative")))).collect()}
    assert texts["up"].startswith("Selected scenario Promo (up) for forecast f1. Promo: Total volume")
    assert texts["calm"].endswith("Primary KPI Total Volume: base=1000.0, scenario=1000.0, delta=0.0.")


def test_list_scenarios(spark):
    df = spark.createDataFrame([("s1", "f1", "p1", "n", 0), ("s2", "f1", "p2", None, 1), ("s3", "f2", "p1", None, 2)], SCENARIO)

    def ids(**kw):
        return {r.scenario_id for r in scenario.list_scenarios(df, **kw).collect()}

    assert ids() == {"s1", "s2", "s3"} and ids(forecast_id="f1") == {"s1", "s2"} and ids(forecast_id="f1", plan_id="p1") == {"s1"}


@pytest.mark.parametrize("count", [0, 1, 7])
def test_scenario_overview(spark, count):
    df = spark.createDataFrame([(f"abcdefgh-{i}", "f", None, "n" if i else None, i) for i in range(count)], SCENARIO)
    row = reports.scenario_overview(df).first()
    assert row.scenarios == count
    if count == 0:
        assert row.text == "No scenarios have been created yet."
    else:
        assert row.text.startswith(f"There are {count} scenarios in the current session. Examples: Scenario (abcdefgh...) for forecast f")
        assert row.text.count("for forecast") == min(count, 5)


# --- explanation


def test_drivers_grow_with_the_rank(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "sku string")
    got = {(r.sku, r.feature): r.importance for r in explain.drivers_by_sku(df).collect()}
    assert len(got) == 18
    assert got[("a", "trend")] == 0.3 and got[("b", "trend")] == pytest.approx(0.315) and got[("c", "weather")] == pytest.approx(0.055)
    top = explain.global_drivers(spark).orderBy("position").collect()
    assert [r.feature for r in top] == ["trend", "seasonality", "promotion", "holiday", "price", "weather"]
    assert sum(r.importance for r in top) == pytest.approx(1.0)
    assert {r.feature for r in top if r.direction == "negative"} == {"price", "weather"}


@pytest.mark.parametrize("ranges", [1, 3, 256])
def test_ranks_are_those_of_a_full_sort(spark, ranges):
    names = sorted({f"S{(i * 7919) % 1000}" for i in range(400)})
    df = spark.createDataFrame([(n,) for n in names * 2], "sku string").repartition(5)
    assert {r.sku: r["rank"] for r in explain.ranked_skus(df, ranges).collect()} == {n: i for i, n in enumerate(names)}


SIGNALS = "date date, location string, google_trends_index double, temperature double, is_holiday int"


def summary(df, **kw):
    return explain.signal_summary(df, **kw).first().summary


def test_signal_summary_by_hand(spark):
    def day(n):
        return dt.date(2024, 1, n)

    rows = [(day(1), "A", 900.0, -40.0, 1), (day(6), "B", 50.0, 1.25, 0), (day(6), "A", 40.0, 2.0, 0), (day(20), "A", 50.5, 3.35, None), (day(20), "B", 60.0, None, 0)]
    df = spark.createDataFrame(rows, SIGNALS)
    assert summary(df) == (
        "Google search interest moved from 40 to 60 over the last 14 days (+50.0% change). "
        "Observed temperature range in the same window: 1.2–3.4°C."
    )
    assert summary(df, days=19).endswith("Recent days include holidays, which may drive demand peaks.")
    assert summary(df, location="A").startswith("Google search interest moved from 40 to 50 over the last 14 days (+26.2% change).")
    assert summary(df, location="nowhere") is None
    assert summary(df.select("date", "location")) is None
    assert summary(df.where("location = 'B'").withColumn("google_trends_index", F.lit(0.0))).startswith(
        "Google search interest moved from 0 to 0 over the last 14 days (+0.0% change)."
    )


# --- reports


def test_top_skus(points):
    rows = reports.top_skus(points, 2).orderBy("rank").collect()
    assert [tuple(r) for r in rows] == [(1, "b", 60.0, 1.0), (2, "a", 30.0, 0.5)]
    zero = reports.top_skus(points.where("sku = 'c'")).first()
    assert (zero.total, zero.share) == (0.0, 0.0)


def test_totals_by_date_and_limits(points, nothing):
    by_date = reports.totals_by_date(points)
    rows = {r.date: r for r in by_date.collect()}
    assert (rows[D1].label, rows[D1]["mean"], rows[D1].q90) == ("01-01", 30.0, 36.0)
    assert tuple(reports.band_limits(by_date).first()) == (72.0, 24.0, 21, 80)
    assert tuple(reports.band_limits(reports.totals_by_date(nothing)).first()) == (1.0, 0.0, 0, 2)
    flat = by_date.withColumns({"q10": F.lit(0.0), "q90": F.lit(0.0)})
    assert tuple(reports.band_limits(flat).first())[:2] == (60.0, 30.0)
    assert reports.first_periods(by_date, 1).first().date == D1


def test_pivot(points):
    names = [r.sku for r in points.select("sku").distinct().orderBy("sku").collect()]
    for table in (reports.pivot_by_sku(points), reports.pivot_by_sku(points, names)):
        assert table.columns == ["date", *names]
        rows = {r.date: r for r in table.collect()}
        assert rows[D1]["a"] == 30.0 and rows[D1]["b"] is None and rows[D3]["b"] == 60.0
    with pytest.raises(ValueError, match="not in the list"):
        reports.pivot_by_sku(points, names[1:])
    with pytest.raises(ValueError, match="more than 1"):
        reports.pivot_by_sku(points, most=1)
    long = {(r.date, r.sku): r["mean"] for r in reports.mean_by_sku_and_date(points).collect()}
    assert long[D1, "a"] == 30.0 and (D1, "b") not in long


def test_forecast_totals(points, nothing):
    assert tuple(reports.forecast_totals(points).first()) == (90.0, 2, 3, "90 units", "2 periods · 3 SKUs")
    assert reports.forecast_totals(points.where("sku = 'a'")).first().horizon_label == "1 period · 1 SKU"
    assert tuple(reports.forecast_totals(nothing).first()) == (0.0, 0, 0, "—", None)


KPIS = "position int, name string, value double, unit string"


@pytest.mark.parametrize(
    "rows, volume, service",
    [
        ([(0, "Total Volume", 12345.5, "units"), (1, "Target Service Level", 0.95, "")], "12,346 units", "95.0%"),
        ([(0, "Service Level", 97.25, None), (1, "Total", 7.0, " ")], "7 units", "97.3"),
        ([(0, "Service Level", 97.0, "pct")], None, "97.00 pct"),
        ([(0, "Other", 1.0, "x"), (1, "TOTAL cost", 2.0, "eur"), (2, "Total", 3.0, "x")], "2 eur", "—"),
    ],
)
def test_kpi_lookup(spark, rows, volume, service):
    row = reports.kpi_lookup(spark.createDataFrame(rows, KPIS)).first()
    assert (row.volume_label, row.service_label) == (volume, service)


def test_plan_text_keeps_the_first_six(spark):
    rows = [("p", i, f"k{i}", i + 0.125, "u" if i else None) for i in range(8)]
    text = reports.plan_kpi_text(spark.createDataFrame(rows, "plan_id string, " + KPIS)).first().text
    assert text == "Key KPIs: k0: 0.12 ; k1: 1.12 u; k2: 2.12 u; k3: 3.12 u; k4: 4.12 u; k5: 5.12 u."


def test_latest(spark):
    df = spark.createDataFrame([("x", 1), ("z", 3), ("y", 2)], "id string, created_at int")
    assert reports.latest(df, "id").first().id == "z"
    assert reports.latest(df, "id", "y").first().id == "y"
    assert reports.latest(df, "id", "unknown").first().id == "z"
    assert reports.latest(df.where("false"), "id").count() == 0


def test_forecast_text(spark, points):
    header = spark.createDataFrame([("f1", "m", "1")], "forecast_id string, model_name string, model_version string")
    models = spark.createDataFrame([("a", "stub", 1), ("b", "arima", 0), ("c", "stub", 2)], "sku string, model string, seq int")
    text = reports.forecast_text(header, points, models, 2).first().text
    assert text == (
        "Forecast f1 uses model m v1. Top SKUs by volume: b (~60.0 units), a (~30.0 units). "
        "Per-SKU model selection: arima: 1 SKUs, stub: 2 SKUs."
    )


@pytest.mark.parametrize(
    "value, digits, sign",
    [(2.5, 0, False), (3.5, 0, False), (0.125, 2, False), (-0.04, 1, True), (1234.56, 1, True), (0.0, 1, True), (-2.25, 1, True),
     (-0.3, 0, False), (math.inf, 1, True), (-math.inf, 1, False), (math.nan, 1, True), (1e-9, 2, False), (1005.0, 0, False)],
)
def test_fixed_matches_python(spark, value, digits, sign):
    got = spark.range(1).select(fixed(F.lit(value), digits, sign)).first()[0]
    assert got == f"{value:{'+' if sign else ''}.{digits}f}"


def test_grouped_whole(spark):
    got = spark.range(1).select(grouped_whole(F.lit(1234567.5)), grouped_whole(F.lit(2.5))).first()
    assert tuple(got) == ("1,234,568", "3")
