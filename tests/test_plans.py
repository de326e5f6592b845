"""What the physical plans must and must not contain."""

import re

import pytest

import __spark_entry__ as entry
from demandloom.plans.star_queries import QUERIES


def plan_of(spark, small, name):
    return entry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pair_joins_and_no_row_by_row_python(spark, small, name):
    plan = plan_of(spark, small, name)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroupsInPandas", "Scan ExistingRDD"):
        assert node not in plan
    # Sorting windows run per SKU or per range of SKUs, never over a whole table.
    assert not re.search(r"Window \[.*\n.*Sort.*\n.*Exchange SinglePartition", plan)


@pytest.mark.parametrize(
    "name, schema",
    [
        ("naive_mape", "struct<l_quantity:double,l_shipdate:timestamp_ntz>"),
        ("daily_demand", "struct<l_partkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>"),
        ("drivers_by_sku", "struct<l_partkey:bigint>"),
        ("session_counts", "struct<>"),
    ],
)
def test_scans_read_only_the_columns_they_need(spark, small, name, schema):
    assert f"ReadSchema: {schema}" in plan_of(spark, small, name)


@pytest.mark.parametrize("name, pushed", [("event_demand", "EqualTo(event_type,purchase)")])
def test_filters_reach_the_scan(spark, small, name, pushed):
    assert pushed in plan_of(spark, small, name)


@pytest.mark.parametrize("name", ["daily_demand", "naive_mape", "scenario_kpis", "demand_summary", "dataset_kind", "guess_columns"])
def test_rows_are_summed_before_they_are_shuffled(spark, small, name):
    assert "partial_" in plan_of(spark, small, name)


def test_signals_meet_sales_as_sums_per_key(spark, small):
    plan = plan_of(spark, small, "daily_demand_repeated_signals")
    join = plan.index("LeftOuter")
    below = plan[join:]
    assert "sum(quantity" in below and "count(1)" in below


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit, shuffled", [("10485760", False), ("-1", True)])
def test_small_signals_spare_the_sales_a_shuffle(spark, small, limit, shuffled):
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, limit)
    try:
        df = entry.queries()["sales_with_signals"](spark, small)
        plan = final_plan(df).split("== Initial Plan ==")[0]
        rows = df.count()
    finally:
        spark.conf.set(setting, before)
    outer = plan[: plan.index("l_shipdate")]
    assert ("SortMergeJoin" in outer or "Exchange hashpartitioning" in outer) == shuffled
    assert rows == spark.read.parquet(f"{small}/lineitem.parquet").count()


def test_profile_counts_keys_without_repeating_rows(spark, small):
    assert "Expand" not in plan_of(spark, small, "dataset_profile")


def test_profile_scans_once_and_has_no_window(spark, small):
    df = entry.queries()["dataset_profile"](spark, small)
    plan = final_plan(df)  # the counts of both keys read the sums per (sku, location) again
    assert "Window" not in plan and plan.count("ReusedExchange [sku") >= 2


def test_names_that_fit_no_role_are_not_shuffled(spark, small):
    plan = plan_of(spark, small, "guess_columns")
    # The filter on the names stands below the last exchange, and cleans a name once for all words.
    below = plan[plan.rindex("Exchange") :]
    assert "RLIKE" in below and "exists(" not in below
