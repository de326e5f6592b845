"""Layout of stored results: packed headers, and rows in buckets by SKU."""

import datetime as dt
import os

import pytest

from demandloom.operators import explain, supply
from demandloom.operators.forecast import forecast_points
from demandloom.sources import store as module
from demandloom.sources.store import ResultNotFound, ResultStore
from pyspark.sql import functions as F


def header(spark, i):
    return spark.createDataFrame([(f"name {i}", i)], "name string, n int")


def files(root):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_headers_are_packed_as_they_gather(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path))
    for i in range(14):
        store.add_header("t", header(spark, i), "key", f"r{i}")
        assert store.headers("t", "key").count() == i + 1
    assert len(files(tmp_path)) <= module.PACK_AFTER
    assert store.one("t", "key", "r0").first().asDict() == {"name": "name 0", "n": 0, "key": "r0"}
    with pytest.raises(ResultNotFound):
        store.one("t", "key", "r99")
    assert store.headers("other", "key") is None


def test_a_thousand_results_open_few_files(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path))
    rows = spark.range(1000).select(F.concat(F.lit("r"), "id").alias("key"), F.col("id").alias("n"), F.lit("2024-05-06").alias("day"))
    rows.repartition(200).write.parquet(str(tmp_path / "t" / "loose"))
    store.pack("t", "key")
    store.add_header("t", spark.createDataFrame([(1000,)], "n long"), "key", "r1000")
    listed = store.headers("t", "key")
    assert listed.count() == 1001 and len(listed.inputFiles()) <= 10


def test_a_pack_that_broke_off_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    store = ResultStore(spark, str(tmp_path))
    for i in range(4):
        store.add_header("t", header(spark, i), "key", f"r{i}")
    removed = []
    monkeypatch.setattr(store, "_remove", removed.append)  # the driver is lost before it removes anything
    store.pack("t", "key")
    assert len(removed) == 4 and store.headers("t", "key").count() == 4
    monkeypatch.undo()
    store.pack("t", "key")
    assert store.headers("t", "key").count() == 4 and len(files(tmp_path)) == 1
    # A pack without its mark of success is not read.
    (tmp_path / "t" / "packed" / "2024-01-01" / "x").mkdir(parents=True)
    header(spark, 9).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "t" / "packed" / "2024-01-01" / "x"))
    os.remove(tmp_path / "t" / "packed" / "2024-01-01" / "x" / "_SUCCESS")
    assert store.headers("t", "key").count() == 4


def test_two_packs_at_a_time(spark, tmp_path, monkeypatch):
    """The second pack reads before the first removes, and removes after a header has come in between."""
    one, two = ResultStore(spark, str(tmp_path)), ResultStore(spark, str(tmp_path))
    for i in range(3):
        one.add_header("t", header(spark, i), "key", f"r{i}")
    removed = []
    monkeypatch.setattr(one, "_remove", removed.append)
    one.pack("t", "key")
    two.add_header("t", header(spark, 3), "key", "r3")
    two.pack("t", "key")
    monkeypatch.undo()
    for path in removed:
        one._remove(path)
    assert {r.key for r in two.headers("t", "key").collect()} == {"r0", "r1", "r2", "r3"}


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    store = ResultStore(spark, str(tmp_path_factory.mktemp("it's")), buckets=4)
    days = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    rows = [(f"S{i:03d}", 5, 10.0 + i, "stub", days, [1.0 + i, 2.0, 3.0]) for i in range(50)]
    fits = spark.createDataFrame(rows, "sku string, history int, base double, model string, horizon array<date>, path array<double>")
    store.save_by_sku("fits", fits, "forecast_id", "f")
    store.save_by_sku("points", forecast_points(store.by_sku("fits", "forecast_id", "f")), "forecast_id", "f")
    return store


def test_one_file_per_bucket(saved):
    assert len([f for f in files(saved.root) if "/fits/" in f]) == 4
    points = saved.by_sku("points", "forecast_id", "f")
    assert points.count() == 150 and points.select("forecast_id").distinct().first()[0] == "f"
    assert sorted(map(tuple, points.collect())) == sorted(map(tuple, saved.load("points", "forecast_id", "f").select(points.columns).collect()))
    assert saved.by_sku("points", "forecast_id", "none") is None
    assert not [t for t in saved.spark.catalog.listTables() if t.name.startswith("loom_")]


def test_sums_and_joins_by_sku_need_no_exchange(spark, saved):
    points, fits = (saved.by_sku(t, "forecast_id", "f") for t in ("points", "fits"))
    demand = supply.demand_summary(points, F.struct(F.lit(dt.date(2024, 1, 1)).alias("first"), F.lit(dt.date(2024, 1, 3)).alias("last")))
    assert demand.count() == 50 and "Exchange" not in plan(demand)
    joined = points.hint("merge").join(fits.select("sku", "model"), "sku")
    assert joined.count() == 150 and "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined)
    skus = points.select("sku").distinct()
    assert "Exchange" not in plan(skus) and "Exchange" in plan(saved.load("points", "forecast_id", "f").select("sku").distinct())
    assert explain.drivers_by_sku(points).count() == 300


def test_a_rerun_replaces_its_result(spark, saved):
    one = spark.createDataFrame([("A", 1.0)], "sku string, mean double")
    for rows in (one.union(one), one, one.limit(0)):
        saved.save_by_sku("again", rows, "forecast_id", "x")
        found = saved.by_sku("again", "forecast_id", "x")
        assert (0 if found is None else found.count()) == rows.count()
