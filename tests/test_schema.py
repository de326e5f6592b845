"""Names, harmonising, checks and profiles."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from demandloom.functions.names import clean_name, clean_name_col, guess_column
from demandloom.operators import catalog, profile
from demandloom.operators.harmonize import harmonize_sales, sales_columns, unreadable_sales
from demandloom.schemas import SALES_ROLES
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "style, cleaned",
    [("ingest", "order-dateid"), ("upload", "order-dateid"), ("screen", "orderdateid"), ("defaults", "order-dateid")],
)
def test_clean_name(spark, style, cleaned):
    assert clean_name("Order-Date _ID", style) == cleaned
    assert spark.range(1).select(clean_name_col(F.lit("Order-Date _ID"), style)).first()[0] == cleaned


@pytest.mark.parametrize(
    "names, candidates, wanted",
    [
        (["Order_Date", "date"], ["date", "order_date"], "date"),
        (["updated_by", "qty"], ["date"], "updated_by"),
        (["a date", "A_Date"], ["adate"], "A_Date"),
        (["Sales Units", "Order Qty"], ["quantity", "qty", "units"], "Order Qty"),
        (["x"], ["date"], None),
        ([], ["date"], None),
    ],
)
def test_guess_column(names, candidates, wanted):
    assert guess_column(names, candidates) == wanted


def test_guess_by_candidate_prefers_earlier_candidates():
    names = ["product_name", "sku_code", "product"]
    assert guess_column(names, ["sku", "product"], "defaults", by_candidate=True) == "sku_code"
    assert guess_column(names, ["sku", "product"]) == "product"


NAMES = st.sampled_from(
    ["Order_Date", "order date", "DATE", "Product", "product_id", "Region", "Store", "Qty", "Item Qty", "Units", "notes"]
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(NAMES, min_size=1, max_size=6), min_size=1, max_size=5), st.booleans())
def test_catalog_guess_equals_single_guess(spark, tables, by_candidate):
    rows = [(f"d{i}", pos, name) for i, names in enumerate(tables) for pos, name in enumerate(names)]
    df = spark.createDataFrame(rows, "dataset string, pos int, column string")
    style = "defaults" if by_candidate else "ingest"
    got = {(r.dataset, r.role): r.column for r in catalog.guess_columns(df, style=style, by_candidate=by_candidate).collect()}
    for i, names in enumerate(tables):
        for role, candidates in SALES_ROLES.items():
            assert got.get((f"d{i}", role)) == guess_column(names, candidates, style, by_candidate)


def test_sales_columns_roles():
    assert sales_columns(["Order_Date", "Product", "Region", "Qty"]) == {
        "Order_Date": "date", "Product": "sku", "Region": "location", "Qty": "quantity",
    }
    assert sales_columns(["date", "item_qty"]) == {"date": "date", "item_qty": "quantity"}
    assert sales_columns(["item_date", "qty"]) == {"item_date": "date", "qty": "quantity"}
    for bad in (["Product", "Qty"], ["date"], ["date_units"]):
        with pytest.raises(ValueError):
            sales_columns(bad)


def test_harmonize_fills_missing_keys_and_keeps_other_columns(spark):
    raw = spark.createDataFrame([("1/31/2024", "3", "x"), ("soon", "many", None)], "when_date string, Qty string, `a b` string")
    out = harmonize_sales(raw)
    assert out.columns == ["date", "sku", "location", "quantity", "a b"]
    assert [tuple(r) for r in out.collect()] == [
        (dt.date(2024, 1, 31), "ALL-SKU", "ALL-LOC", 3.0, "x"), (None, "ALL-SKU", "ALL-LOC", None, None),
    ]
    assert unreadable_sales(raw).first().asDict() == {"rows": 2, "bad_dates": 1, "bad_quantities": 1}


def test_harmonize_turns_nan_into_null_and_timestamps_into_dates(spark):
    raw = spark.sql("SELECT timestamp_ntz'2024-05-01 13:00:00' AS date, 'S1' AS sku, double('NaN') AS quantity")
    assert tuple(harmonize_sales(raw).first()) == (dt.date(2024, 5, 1), "S1", "ALL-LOC", None)


def test_harmonize_refuses_a_repeated_role(spark):
    raw = spark.createDataFrame([("2024-01-01", 1.0, 2.0)], "date string, quantity double, `Quantity ` double")
    with pytest.raises(ValueError):
        harmonize_sales(raw)


def test_missing_columns(spark):
    rows = [("a", "inventory", 0, "Date"), ("a", "inventory", 1, "Stock Level"), ("b", "sales", 0, "x"), ("c", "master_data", 0, "UOM"),
            ("d", "external_signals", 0, "DATE"), ("d", "external_signals", 1, "location"), ("e", "other", 0, "x")]
    df = spark.createDataFrame(rows, "dataset string, kind string, pos int, column string")
    got = {r.dataset: r.missing for r in catalog.missing_columns(df).collect()}
    assert got == {"a": "location, sku", "b": "", "c": "category, description, sku", "d": "", "e": ""}
    assert profile.schema_warnings(["Date", "Stock Level"], "inventory") == ["Missing expected columns for inventory: location, sku"]
    assert profile.schema_warnings(["anything"], "sales") == []


@pytest.mark.parametrize(
    "columns, kind",
    [
        (["order_date", "sku", "qty"], "sales"),
        (["stock_level", "on-hand", "reorder"], "inventory"),
        (["amount"], None),
        (["volume", "period"], "sales"),
        (["machine"], None),
        (["foo"], None),
        (["weather", "holiday"], "external_signals"),
    ],
)
def test_dataset_kinds(spark, columns, kind):
    df = spark.createDataFrame([("d", i, c) for i, c in enumerate(columns)], "dataset string, pos int, column string")
    assert catalog.dataset_kinds(df).first().kind == kind


def test_column_roles(spark):
    df = spark.sql("SELECT 1 AS n, 'x' AS updated_by, true AS flag, date'2024-01-01' AS seen, '1.5' AS text_number, cast(1 AS decimal(9,2)) AS money")
    roles = {r.name: (r.dtype, r.role) for r in profile.column_roles(df).collect()}
    assert roles["n"] == ("int", "numeric") and roles["updated_by"] == ("string", "date")
    assert roles["flag"][1] == "categorical" and roles["seen"][1] == "date"
    assert roles["text_number"] == ("double", "numeric") and roles["money"][1] == "numeric"
    assert {r.name: r.role for r in profile.column_roles(df, infer_text=False).collect()}["text_number"] == "categorical"


def test_profile_text(spark):
    df = spark.sql("SELECT date'2024-01-02' AS date, 'a' AS sku, 1 AS c, 2 AS d, 3 AS e, 4 AS f, 5 AS g, 6 AS h UNION ALL SELECT null, 'a', 1, 2, 3, 4, 5, 6")
    text = profile.profile_text(profile.dataset_profile(df), "sales", "sales.csv").first().text
    assert text == (
        "Dataset sales currently loaded from sales.csv has 2 rows and 8 columns. "
        "Example columns: date, sku, c, d, e, f (+2 more columns). Distinct SKUs: 1. Date coverage: 2024-01-02 to 2024-01-02."
    )


def test_profile_leaves_out_dates_it_cannot_read(spark):
    df = spark.createDataFrame([("2024-01-02",), ("soon",), (None,)], "date string")
    assert profile.dataset_profile(df).first().first_date is None
    assert str(profile.dataset_profile(df.where("date <> 'soon'")).first().first_date) == "2024-01-02"


def test_default_skus_take_the_first_distinct_texts(spark):
    rows = [(3, "b"), (1, "a"), (2, " "), (4, None), (5, "a"), (6, "c")]
    df = spark.createDataFrame(rows, "n int, product string")
    assert [r.sku for r in profile.default_skus(df, ["n"], 2).orderBy("place").collect()] == ["a", "b"]
    assert profile.default_skus(df.select("n", F.col("n").alias("sku")), ["n"]).count() == 0
