"""Types found in files, rows with surplus fields, and values that cannot be read."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandloom.operators.harmonize import UnreadableSales, harmonize_sales
from demandloom.operators.history import daily_demand, pack_series
from demandloom.plans.flow import PlanningFlow
from demandloom.plans.requests import ForecastRequest
from demandloom.sources.datasets import Datasets
from demandloom.sources.files import read_csv, typed, unreadable_rows
from demandloom.sources.infer import infer_types, type_table, with_types
from demandloom.sources.watch import UnreadableValues, Watch


def write(path, text):
    path.write_text(text)
    return str(path)


# --- inference

COLUMNS = {
    "whole": (["1", "-20", None, " 3 "], "bigint"),
    "big": (["123456789012345678", "1234567890123456789", "1", "2"], "double"),
    "real": (["1", "2.5", ".5", "-1e3"], "double"),
    "nan": (["1", "NaN", "inf", "2"], "double"),
    "flag": (["True", "false", "TRUE", None], "boolean"),
    "flag_and_number": (["true", "1", "0", "false"], "string"),
    "key": (["007", "1", "2", "3"], "string"),
    "zero": (["0", "0.5", "10", "-0"], "double"),
    "day": (["2024-01-02", "1/31/24", "3 Feb 2024", None], "date"),
    "no_such_day": (["2024-01-02", "2024-13-02", "2024-01-03", "x"], "string"),
    "stamp_number": (["20240131", "20240201", "20240202", "20240203"], "bigint"),
    "date_number": (["20240131", "20240201", "2024-02-02", None], "date"),
    "date_count": (["1", "20240201", "12345", "2"], "bigint"),
    "word": (["1", "two", "3", "4"], "string"),
    "empty": ([None, None, None, None], "double"),
    "SKU": (["1", "2", "3", "4"], "string"),
    "Product ID": (["1", "2", "3", "4"], "string"),
}


@pytest.fixture(scope="module")
def mixed(spark):
    rows = list(zip(*[v for v, _ in COLUMNS.values()]))
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in COLUMNS))


def test_each_column_gets_the_type_of_all_its_values(mixed):
    assert type_table(mixed) == {c: t for c, (_, t) in COLUMNS.items()}
    filled = {r.name: (r.pos, r.filled, r.missing) for r in infer_types(mixed).collect()}
    assert filled["day"] == (8, 3, 1) and filled["empty"] == (14, 0, 4)


def test_no_value_is_lost_by_its_type(mixed):
    read = with_types(mixed, type_table(mixed))
    assert dict(read.dtypes) == {c: t for c, (_, t) in COLUMNS.items()}
    lost = read.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in COLUMNS]).first().asDict()
    # Not a number is a missing value.
    assert lost == {c: sum(x is not None for x in v) - (c == "nan") for c, (v, _) in COLUMNS.items()}
    assert [r.day for r in read.select("day").collect()][:3] == [dt.date(2024, 1, 2), dt.date(2024, 1, 31), dt.date(2024, 2, 3)]


def test_inference_of_other_types_and_empty_tables(spark):
    df = spark.createDataFrame([], "a string, `b.c` int, d array<string>, sku string")
    assert [(r.name, r.dtype) for r in infer_types(df).collect()] == [("a", "double"), ("b.c", "int"), ("d", "array<string>"), ("sku", "string")]
    assert infer_types(df.select(F.col("`b.c`"))).first().dtype == "int"


def test_one_scan_whatever_the_number_of_columns(mixed, tmp_path):
    mixed.write.parquet(str(tmp_path / "t"))
    df = infer_types(mixed.sparkSession.read.parquet(str(tmp_path / "t")))
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_uploads_keep_their_types(spark, tmp_path):
    data = Datasets(spark, str(tmp_path / "data"))
    path = write(tmp_path / "s.csv", "Order Date,SKU,Qty,Rush,Note\n1/2/24,001,5,True,\n1/3/24,002,7,False,\n")
    wanted = [("Order Date", "date"), ("SKU", "string"), ("Qty", "bigint"), ("Rush", "boolean"), ("Note", "double")]
    assert data.upload("sales", path).dtypes == wanted == data.read("sales").dtypes
    assert data.read("sales").orderBy("SKU").first().SKU == "001"
    (tmp_path / "data" / "sample_inventory.csv").write_text("date,sku,location,stock_level,checked\n2024-01-02,1,W,5,2024-01-03\n")
    assert data.read("inventory").dtypes == [("date", "date"), ("sku", "string"), ("location", "string"), ("stock_level", "double"), ("checked", "date")]


# --- surplus fields

LONG = 'date,sku,qty\n2024-01-01,A,5\n2024-01-02,A,6,77\n2024-01-03,"A,B",7\n2024-01-04,C\n2024-01-05,D,1,\n'


def test_a_row_with_too_many_fields_fails_the_scan(spark, tmp_path):
    df = read_csv(spark, write(tmp_path / "l.csv", LONG))
    for use in (df.collect, df.count, df.select("sku").collect):
        with pytest.raises(Exception, match="more than 3 fields"):
            use()
    fine = read_csv(spark, write(tmp_path / "f.csv", "".join(x + "\n" for x in LONG.split("\n") if x and not x.startswith(("2024-01-02", "2024-01-05")))))
    # A short row has missing values at its end, and a quoted comma parts nothing.
    assert sorted(map(tuple, fine.collect()), key=str) == [("2024-01-01", "A", "5"), ("2024-01-03", "A,B", "7"), ("2024-01-04", "C", None)]
    assert fine.count() == 3 and fine.select("qty").dropna().count() == 2


def test_uploads_with_surplus_fields(spark, tmp_path):
    data, path = Datasets(spark, str(tmp_path / "data")), write(tmp_path / "l.csv", LONG)
    with pytest.raises(UnreadableValues, match="2 rows of .* more fields"):
        data.upload("sales", path)
    assert data.location("sales") is None
    data.upload("sales", path, on_bad="quarantine")
    assert data.read("sales").count() == 3
    assert {r.record for r in data.bad_rows("sales").collect()} == {"2024-01-02,A,6,77", "2024-01-05,D,1,"}
    assert tuple(data.uploads().select("rows", "bad_rows").first()) == (3, 2)
    with pytest.raises(ValueError):
        data.upload("sales", path, on_bad="drop")


# --- unreadable values

SIGNALS = "date,location,is_holiday,temperature\n2024-01-01,L,1,3.5\njunk,L,0,4\n31st May,L,maybe,5\n2024-01-02,L,,\n"


def test_rows_that_cannot_be_read_are_set_apart(spark, tmp_path):
    raw = read_csv(spark, write(tmp_path / "s.csv", SIGNALS))
    bad = {r.date: r.unreadable for r in unreadable_rows(raw, "external_signals").collect()}
    assert bad == {"junk": "date", "31st May": "date,is_holiday"}
    assert unreadable_rows(raw, "master_data").count() == 0
    watch = Watch("signals")
    assert typed(raw, "external_signals", watch).collect() == typed(raw, "external_signals").collect()
    assert watch.rows == 4 and watch.bad() == {"date": (2, "31st May"), "is_holiday": (1, "maybe")}
    with pytest.raises(UnreadableValues, match="4 signals rows cannot be read: 2 in 'date'"):
        watch.check()


def test_a_watch_counts_in_the_job_that_reads(spark, monkeypatch):
    rows = [(f"2024-01-{d:02d}", "A", "L", "5" if d % 3 else "many") for d in range(1, 20)]
    raw = spark.createDataFrame(rows, "date string, sku string, location string, qty string").repartition(3)
    watch = Watch("sales")
    pack_series(daily_demand(harmonize_sales(raw, watch=watch))).collect()
    monkeypatch.setattr(watch, "_rows", None)  # a job of its own would fail
    assert watch.rows == 19 and watch.bad() == {"quantity": (6, "many")}


def test_a_watch_of_rows_that_no_job_read(spark, monkeypatch):
    monkeypatch.setattr(Watch, "PATIENCE", 0.2)
    watch = Watch("t")
    watch.over(spark.createDataFrame([("a",), (None,)], "x string"), {"x": (F.col("x") == "a", F.col("x"))})
    assert watch.rows == 2 and watch.bad() == {"x": (1, "a")}


@pytest.fixture
def flow(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    lines = "".join(f"2024-01-{d:02d},A,L,{d}\n" for d in range(1, 12))
    write(data / "sample_sales.csv", "Order_Date,Product,Region,Qty\n" + lines)
    write(data / "sample_external_signals.csv", SIGNALS)
    return PlanningFlow(spark, str(data), str(tmp_path / "results"))


def test_junk_signals_stop_every_run(flow):
    request = ForecastRequest(dt.date(2024, 1, 12), dt.date(2024, 1, 14), forced_model="stub")
    for call in (lambda: flow.create_forecast(request), flow.monitor, flow.train):
        with pytest.raises(UnreadableValues, match="4 external_signals rows"):
            call()
    assert flow.headers("forecasts").isEmpty() and flow.store.table("runs") is None
    forecast_id = flow.create_forecast(request, on_unreadable="keep")
    assert {(r.dataset, r.column, r.bad, r.example) for r in flow.bad_rows(forecast_id).collect()} == {
        ("external_signals", "date", 2, "31st May"), ("external_signals", "is_holiday", 1, "maybe")
    }
    with pytest.raises(UnreadableValues):
        flow.explain(forecast_id)
    assert flow.explain(forecast_id, "keep")["external_summary"].count() == 1
    assert flow.bad_rows("none").count() == 0


def test_unreadable_sales_keep_their_own_error(spark, flow):
    path = flow.datasets.root + "/sample_sales.csv"
    with open(path, "a") as f:
        f.write("soon,A,L,1\n")
    with pytest.raises(UnreadableSales, match="1 dates and 0 quantities of 12"):
        flow.monitor()
