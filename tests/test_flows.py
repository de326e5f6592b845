"""Files, uploads, stores, publishing, and the whole flow."""

import datetime as dt
import json

import pytest

from demandloom.operators.enrich import sales_with_signals
from demandloom.operators.explain import signal_summary
from demandloom.operators.harmonize import UnreadableSales
from demandloom.plans.jobs import run
from demandloom.plans.flow import PlanningFlow
from demandloom.plans.requests import ForecastRequest, PlanRequest, ScenarioRequest, Shock, split_skus
from demandloom.sources.datasets import DatasetNotFound, Datasets
from demandloom.sources.files import read_csv, typed, write_csv
from demandloom.sources.jdbc import jdbc_options
from demandloom.sources.store import ResultNotFound, ResultStore
from demandloom.streaming.publish import as_events, publish
from pyspark.sql import functions as F


def write(path, text):
    path.write_text(text)
    return str(path)


# --- files


def test_csv_keeps_keys_and_reads_missing_texts(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'sku,note,stock_level,date\n001,"say ""hi"", ok",5,2024-01-02\nNA,,n/a,soon\n')
    rows = [tuple(r) for r in typed(read_csv(spark, path), "inventory").collect()]
    assert rows == [("001", 'say "hi", ok', 5.0, dt.date(2024, 1, 2)), (None, None, None, None)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", '"q"', None), ("é", "x", "y")], "p string, `q r` string, s string")
    write_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, df.collect()))


def test_multi_line_cells(spark, tmp_path):
    path = write(tmp_path / "m.csv", 'a,b\n"one\ntwo",3\n')
    assert read_csv(spark, path, multi_line=True).first().a == "one\ntwo"


def test_text_booleans_count_as_numbers(spark, tmp_path):
    path = write(tmp_path / "s.csv", "date,location,is_holiday\n2024-01-02,W,True\n2024-01-03,W,FALSE\n2024-01-04,W,maybe\n2024-01-05,W,1\n")
    signals = typed(read_csv(spark, path), "external_signals")
    assert [r.is_holiday for r in signals.orderBy("date").collect()] == [1, 0, None, 1]
    sales = spark.createDataFrame([(dt.date(2024, 1, d), "a", "W", 1.0) for d in (2, 3, 4)], "date date, sku string, location string, quantity double")
    assert [r.is_holiday for r in sales_with_signals(sales, signals).orderBy("date").collect()] == [1, 0, 0]
    assert signal_summary(signals).first().summary == "Recent days include holidays, which may drive demand peaks."


# --- datasets


def test_upload_replaces_the_sample_and_then_itself(spark, tmp_path):
    root = tmp_path / "data"
    root.mkdir()
    data = Datasets(spark, str(root))
    with pytest.raises(DatasetNotFound):
        data.read("sales")
    write(root / "sample_sales.csv", "date,qty\n2024-01-01,1\n")
    assert data.location("sales")[0] == "sample" and data.read("sales").count() == 1
    data.upload("sales", write(tmp_path / "Mine.CSV", "Order Date,Qty\n2024-01-01,1\n2024-01-02,2\n"))
    assert data.location("sales")[0] == "uploaded" and data.read("sales").columns == ["Order Date", "Qty"]
    data.upload("sales", write(tmp_path / "next.csv", "d,q\n2024-01-01,1\n2024-01-02,2\n2024-01-03,3\n"))
    assert data.read("sales").count() == 3
    assert [r.rows for r in data.uploads().orderBy("uploaded_at").collect()] == [2, 3]


def test_bad_uploads_leave_the_good_one(spark, tmp_path):
    data = Datasets(spark, str(tmp_path / "data"))
    data.upload("inventory", write(tmp_path / "i.csv", "date,sku,location,stock_level\n2024-01-01,1,W,5\n"))
    for kind, name in (("toys", "i.csv"), ("inventory", "i.xlsx"), ("inventory", "absent.csv"), ("inventory", "empty.csv")):
        write(tmp_path / "empty.csv", "")
        with pytest.raises(Exception):
            data.upload(kind, str(tmp_path / name))
    assert tuple(data.read("inventory").first()) == (dt.date(2024, 1, 1), "1", "W", 5.0)


def test_upload_with_line_breaks_in_cells(spark, tmp_path):
    data = Datasets(spark, str(tmp_path / "data"))
    path = write(tmp_path / "m.csv", 'sku,description\n1,"two\nlines"\n')
    assert data.upload("master_data", path, multi_line=True).first().description == "two\nlines"
    assert data.read("master_data").count() == 1


# --- other sources


def test_jdbc_options():
    assert jdbc_options("jdbc:x", "t") == {"url": "jdbc:x", "dbtable": "t", "fetchsize": "10000"}
    split = jdbc_options("jdbc:x", "t", "id", 0, 100, 8, user="u")
    assert split["partitionColumn"] == "id" and split["numPartitions"] == "8" and split["user"] == "u"
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", "id")


def test_store_replaces_one_result_only(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path))
    with pytest.raises(ResultNotFound):
        store.load("t", "id", "a")
    one, two = spark.range(2), spark.range(3)
    store.save("t", one, "key", "a")
    store.save("t", two, "key", "b")
    store.save("t", one, "key", "b")
    assert store.load("t", "key", "a").count() == 2 and store.load("t", "key", "b").count() == 2
    with pytest.raises(ResultNotFound):
        store.one("t", "key", "c")


def test_a_lookup_reads_its_own_folder_only(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path))
    for i in range(200):
        (tmp_path / "t" / f"key=r{i}").mkdir(parents=True)
    spark.range(3).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "t" / "key=r7"))
    for found in (store.load("t", "key", "r7"), store.one("t", "key", "r7")):
        assert len(found.inputFiles()) == 1 and {r.key for r in found.collect()} == {"r7"} and found.count() == 3


# --- publishing


def test_events_keep_missing_values(spark):
    df = spark.createDataFrame([(1, None, dt.date(2024, 1, 2))], "a int, b string, c date")
    row = as_events(df, "topic").first()
    assert row.topic == "topic" and json.loads(row.value) == {"a": 1, "b": None, "c": "2024-01-02"}


def test_batch_and_stream_publish_each_row_once(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    bought = F.col("event_type") == "purchase"
    publish(events.where(bought), "sales", sink="text", path=str(tmp_path / "batch"))
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(small)
    with pytest.raises(ValueError):
        publish(stream, "sales", sink="text", path=str(tmp_path / "s"))
    for _ in range(2):  # the second run finds nothing new
        query = publish(
            stream.where(bought), "sales", sink="text", path=str(tmp_path / "stream"), checkpointLocation=str(tmp_path / "cp")
        )
        query.awaitTermination()
    batch, streamed = (sorted(r.value for r in spark.read.text(str(tmp_path / d)).collect()) for d in ("batch", "stream"))
    assert batch == streamed and len(batch) == events.where(bought).count()


# --- requests


def test_requests_are_checked():
    assert split_skus(" a, ,b,") == ["a", "b"]
    day = dt.date(2024, 1, 1)
    for bad in (lambda: ForecastRequest(day, day, granularity="Y"), lambda: PlanRequest("f", objective="fun"), lambda: Shock("rain", day, day)):
        with pytest.raises(ValueError):
            bad()


# --- the flow


@pytest.fixture(scope="module")
def flow(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("flow")
    data = root / "data"
    data.mkdir()
    lines = ["Order_Date,Product,Region,Qty"]
    for i in range(40):
        day = dt.date(2024, 11, 20) + dt.timedelta(days=i)
        lines += [f"{day},SKU-001,WH-1,{20 + i % 7}", f"{day},SKU-002,WH-2,{5 + i}"]
    write(data / "sample_sales.csv", "\n".join(lines) + "\n")
    write(
        data / "sample_external_signals.csv",
        "date,location,is_holiday,temperature,google_trends_index\n2024-12-20,WH-1,0,3.5,40\n2024-12-25,WH-1,1,-1.5,50\n",
    )
    return PlanningFlow(spark, str(data), str(root / "results"))


def _flow_of(spark, tmp_path, lines):
    data = tmp_path / "data"
    data.mkdir()
    write(data / "sample_sales.csv", "Order_Date,Product,Region,Qty\n" + "\n".join(lines) + "\n")
    write(data / "sample_external_signals.csv", "date,location\n2024-01-01,L\n")
    return PlanningFlow(spark, str(data), str(tmp_path / "results"))


def test_two_digit_years_are_history(spark, tmp_path):
    flow = _flow_of(spark, tmp_path, [f"1/{d}/24,A,L,{1000 + d}" for d in range(1, 11)])
    request = ForecastRequest(dt.date(2024, 1, 11), dt.date(2024, 1, 13))
    points = flow.points(flow.create_forecast(request)).collect()
    assert len(points) == 3 and all(700 < p["mean"] < 1300 for p in points)
    assert tuple(flow.headers("forecasts").select("sales_rows", "unreadable_dates", "unreadable_quantities").first()) == (10, 0, 0)


def test_unreadable_sales_raise_unless_they_are_kept(spark, tmp_path):
    flow = _flow_of(spark, tmp_path, ["2024-01-01,A,L,5", "soon,A,L,5", "2024-01-02,A,L,many"])
    request = ForecastRequest(dt.date(2024, 1, 11), dt.date(2024, 1, 12))
    for call in (lambda: flow.create_forecast(request), flow.monitor, flow.train):
        with pytest.raises(UnreadableSales, match="1 dates and 1 quantities of 3"):
            call()
    assert flow.headers("forecasts").isEmpty()
    flow.create_forecast(request, on_unreadable="keep")
    assert tuple(flow.headers("forecasts").select("sales_rows", "unreadable_dates", "unreadable_quantities").first()) == (3, 1, 1)
    assert flow.monitor("keep")["metric"] == "naive_mape"
    with pytest.raises(ValueError):
        flow.monitor("ignore")


def test_empty_session(flow):
    if flow.store.table("forecasts") is None:
        assert flow.forecast_summary() == "No forecasts are available in the current session."
        assert flow.plan_summary() == "No plans are available in the current session."
        assert flow.scenario_summary() == "No scenarios have been created yet."
        assert {r.item: r["items"] for r in flow.session_counts().collect()} == {"forecasts": 0, "plans": 0, "scenarios": 0}
    with pytest.raises(ResultNotFound):
        flow.points("nothing")


def test_forecast_plan_scenario_and_explanation(flow):
    start, end = dt.date(2025, 1, 1), dt.date(2025, 1, 7)
    forecast_id = flow.create_forecast(ForecastRequest(start, end, ["SKU-001", "SKU-002", "SKU-404"], location="WH-1"))
    points = flow.points(forecast_id).collect()
    assert len(points) == 21 and {p.date for p in points} == {start + dt.timedelta(days=i) for i in range(7)}
    models = {r.sku: r.model for r in flow.fits(forecast_id).collect()}
    assert models["SKU-404"] == "stub" and models["SKU-001"] in ("arima", "prophet", "xgboost")
    metrics = {r.key: r.value for r in flow.metrics(forecast_id).collect()}
    assert metrics["SKU-404.chosen_model"] == 0.0 and "SKU-001.arima_mape" in metrics

    plan_id = flow.create_plan(PlanRequest(forecast_id, 0.95, 10, "WH-1"))
    demand = sum(p["mean"] for p in points if p.sku == "SKU-001")
    orders = {r.sku: r for r in flow.plan_table("orders", plan_id).collect()}
    assert orders["SKU-001"].quantity == pytest.approx(0.4 * demand * (1 + 1.65 * 10 / 7))
    assert orders["SKU-001"].location == "WH-1" and orders["SKU-001"].order_date == start

    shock = Shock("demand", start, end, 1.2)
    scenario_id = flow.run_scenario(ScenarioRequest(forecast_id, plan_id, "Demand x1.2", [shock]))
    result = flow.scenario(scenario_id).first()
    total = flow.plan_table("plan_kpis", plan_id).where("name = 'Total Volume'").first().value
    assert result.base == pytest.approx(total) and result.scenario == pytest.approx(1.2 * total)
    assert result.narrative.startswith("Demand x1.2: Total volume increase from ")
    calm = flow.run_scenario(ScenarioRequest(forecast_id))
    assert flow.scenario(calm).first().plan_id == plan_id
    assert flow.scenarios(forecast_id).count() == 2 and flow.scenarios("other").count() == 0

    explained = flow.explain(forecast_id)
    assert explained["global_importance"].count() == 6 and explained["by_sku"].count() == 18
    assert explained["external_summary"].first().summary == (
        "Google search interest moved from 40 to 50 over the last 14 days (+25.0% change). "
        "Observed temperature range in the same window: -1.5–3.5°C. Recent days include holidays, which may drive demand peaks."
    )

    text = flow.forecast_summary("unknown")
    assert text.startswith(f"Forecast {forecast_id} uses model arima_prophet_xgb_ensemble v1.0.0. Top SKUs by volume: SKU-404")
    assert flow.plan_summary().startswith(f"Plan {plan_id} is linked to forecast {forecast_id}. Key KPIs: Total Volume: ")
    assert flow.scenario_summary(scenario_id).startswith(f"Selected scenario Demand x1.2 ({scenario_id}) for forecast")
    assert flow.scenario_summary().startswith("There are 2 scenarios in the current session. Examples: Demand x1.2 (")
    assert flow.dataset_summary("sales").startswith("Dataset sales currently loaded from sample_sales.csv has 80 rows and 4 columns.")
    assert flow.dataset_summary("production") == "Dataset production is not available."
    assert {r.item: r["items"] for r in flow.session_counts().collect()} == {"forecasts": 1, "plans": 1, "scenarios": 2}


def test_preview_and_default_request(flow):
    shown = flow.preview("sales", 3, ["Order_Date", "Product"])
    assert shown["rows"] == 80 and shown["warnings"] == [] and shown["columns"][0] == "Order_Date"
    assert [r.Product for r in shown["preview"].collect()] == ["SKU-001", "SKU-002", "SKU-001"]
    assert {r.name: r.role for r in shown["schema"].collect()}["Qty"] == "numeric"
    request = flow.default_request(["Order_Date", "Product"])
    assert request.skus == ["SKU-001", "SKU-002"]
    assert (request.start_date, request.end_date) == (dt.date(2024, 11, 20), dt.date(2024, 12, 29))
    seen = flow.default_request(["Order_Date", "Product"], preview_rows=3)
    assert seen.skus == ["SKU-001", "SKU-002"] and (seen.start_date, seen.end_date) == (dt.date(2024, 11, 20), dt.date(2024, 11, 21))


def test_missing_plans_are_told_apart(flow):
    with pytest.raises(ResultNotFound):
        flow.run_scenario(ScenarioRequest("any", plan_id="missing"))
    with pytest.raises(ValueError):
        flow.run_scenario(ScenarioRequest("no such forecast"))
    with pytest.raises(ResultNotFound):
        flow.create_plan(PlanRequest("no such forecast"))


def test_empty_horizon_still_makes_a_forecast_and_a_plan(flow):
    forecast_id = flow.create_forecast(ForecastRequest(dt.date(2025, 1, 2), dt.date(2025, 1, 1), ["SKU-001"]))
    assert flow.points(forecast_id).count() == 0 and flow.fits(forecast_id).count() == 1
    plan_id = flow.create_plan(PlanRequest(forecast_id))
    kpis = flow.plan_table("plan_kpis", plan_id)
    assert kpis is None or kpis.count() == 0


def test_first_result_may_be_empty(spark, flow, tmp_path):
    fresh = PlanningFlow(spark, flow.datasets.root, str(tmp_path / "fresh"))
    day = dt.date(2025, 1, 1)
    forecast_id = fresh.create_forecast(ForecastRequest(day + dt.timedelta(days=1), day, ["SKU-001"]))
    assert fresh.points(forecast_id).count() == 0
    plan_id = fresh.create_plan(PlanRequest(forecast_id))
    scenario_id = fresh.run_scenario(ScenarioRequest(forecast_id))
    row = fresh.scenario(scenario_id).first()
    assert (row.plan_id, row.base, row.delta) == (plan_id, 0.0, 0.0)
    assert fresh.plan_summary() == f"Plan {plan_id} is linked to forecast {forecast_id}."


def test_every_sku_is_forecast_without_a_list(flow):
    forecast_id = flow.create_forecast(ForecastRequest(dt.date(2025, 1, 1), dt.date(2025, 1, 31), granularity="W", forced_model="prophet"))
    assert {(r.sku, r.model) for r in flow.fits(forecast_id).collect()} == {("SKU-001", "prophet"), ("SKU-002", "prophet")}
    assert flow.points(forecast_id).count() == 8


def test_training_run_is_logged(flow):
    run("train", flow)
    run("retrain", flow)
    runs = flow.store.table("runs").collect()
    assert len({r.run_id for r in runs}) == len(runs) == 2
    assert runs[0].model_type == "naive_mean" and runs[0].artifact.startswith("baseline_mean=") and runs[0].value > 0
    assert flow.monitor() == {"metric": "naive_mape", "value": runs[0].value}
    with pytest.raises(ValueError):
        run("dance", flow)
