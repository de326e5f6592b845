"""Retraining from kept states against a run over all sales."""

import os

import pytest

from demandloom.operators import monitor
from demandloom.plans.flow import PlanningFlow
from demandloom.plans.jobs import run
from demandloom.sources.datasets import DatasetNotFound
from demandloom.sources.watch import UnreadableValues

SALES = "date string, sku string, location string, quantity double"


@pytest.fixture
def flow(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    (data / "sample_external_signals.csv").write_text("date,location\n2024-01-02,L\n2024-01-02,L\n2024-01-03,M\n")
    (tmp_path / "in").mkdir()
    return PlanningFlow(spark, str(data), str(tmp_path / "results"))


def put(tmp_path, name, rows, header="date,sku,location,qty", moment=None):
    path = tmp_path / "in" / name
    path.write_text(header + "\n" + "".join(",".join(map(str, r)) + "\n" for r in rows))
    if moment:
        os.utime(path, (moment, moment))


def full(spark, flow, rows):
    sales = spark.createDataFrame([(d, s, p, float(q)) for d, s, p, q in rows], SALES).selectExpr("cast(date as date) date", "sku", "location", "quantity")
    row = monitor.train_naive_mean(sales, flow.signals()).first()
    return row.value, row.artifact


def test_only_new_and_changed_files_are_read(spark, flow, tmp_path):
    pattern = str(tmp_path / "in" / "*.csv")
    one = [("2024-01-01", "A", "L", 5), ("2024-01-02", "A", "L", 7), ("2024-01-02", "B", "M", 3)]
    two = [("2024-01-03", "A", "M", 4), ("2024-01-03", "B", "L", 1)]
    late = [("2024-01-01", "C", "M", 9), ("2024-01-04", "C", "L", 2)]  # a day that other files hold already

    def retrain():
        got = flow.retrain(pattern)
        return (got["value"], got["artifact"]), [os.path.basename(p) for p in got["files_read"]]

    put(tmp_path, "one.csv", one, moment=1_700_000_000)
    assert retrain() == (full(spark, flow, one), ["one.csv"])
    put(tmp_path, "two.csv", two)
    assert retrain() == (full(spark, flow, one + two), ["two.csv"])
    put(tmp_path, "late.csv", [(d, p, s, q) for d, s, p, q in late], header="Order Date,Store,Product,Units")
    assert retrain() == (full(spark, flow, one + two + late), ["late.csv"])
    assert retrain() == (full(spark, flow, one + two + late), [])
    corrected = [("2024-01-01", "A", "L", 6), ("2024-01-05", "A", "L", 8)]
    put(tmp_path, "one.csv", corrected, moment=1_700_000_100)
    assert retrain() == (full(spark, flow, corrected + two + late), ["one.csv"])
    os.remove(tmp_path / "in" / "two.csv")
    assert retrain() == (full(spark, flow, corrected + late), [])
    assert flow.store.table("runs").count() == 6


def test_a_file_that_cannot_be_read_leaves_no_state(flow, tmp_path):
    put(tmp_path, "good.csv", [("2024-01-01", "A", "L", 5)])
    put(tmp_path, "junk.csv", [("soon", "A", "L", 5), ("2024-01-02", "A", "L", "many")])
    pattern = str(tmp_path / "in" / "*.csv")
    for _ in range(2):
        with pytest.raises(UnreadableValues, match="1 dates and 1 quantities of 2"):
            flow.retrain(pattern)
    assert len(flow.store.known_states()) == 1 and flow.store.table("runs") is None
    got = flow.retrain(pattern, on_unreadable="keep")
    assert len(got["files_read"]) == 1 and len(flow.store.known_states()) == 2
    with pytest.raises(DatasetNotFound):
        flow.retrain(str(tmp_path / "in" / "*.txt"))


def test_the_job_retrains_on_files(flow, tmp_path, capsys):
    put(tmp_path, "a.csv", [("2024-01-01", "A", "L", 5), ("2024-01-02", "A", "L", 5)])
    run("retrain", flow, str(tmp_path / "in" / "a.csv"))
    assert "files_read" in capsys.readouterr().out


def test_states_of_sources_add_up(spark):
    rows = [("2024-01-01", "A", "L", 5.0), ("2024-01-01", "B", "L", 2.0), ("2024-01-02", "B", None, None), (None, "B", "L", 9.0)]
    sales = spark.createDataFrame(rows, SALES).selectExpr("cast(date as date) date", "sku", "location", "quantity")
    state = monitor.demand_state(sales, sales["sku"])
    assert sorted(map(tuple, state.drop("date").collect()), key=str) == [("A", "L", 5.0, 1), ("B", "L", 2.0, 1), ("B", None, None, 1)]
    assert monitor.naive_mape_of_state(state).first() == monitor.naive_mape(sales).first()
    empty = monitor.demand_state(sales.limit(0), sales["sku"])
    assert monitor.naive_mape_of_state(empty).first().mape is None
