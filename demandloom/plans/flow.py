"""Forecast, plan, scenario and explanation flows over stored tables.

Every step reads tables and writes tables, so a long run survives lost executors and fits are
never computed twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from demandloom.functions.dates import horizon
from demandloom.operators import explain, forecast, monitor, reports, scenario, supply
from demandloom.operators.harmonize import UnreadableSales, harmonize_sales
from demandloom.operators.history import daily_demand, pack_series, requested_skus, resample, whole_periods
from demandloom.operators.profile import (
    column_roles,
    dataset_profile,
    default_dates,
    default_skus,
    preview,
    profile_text,
    schema_warnings,
)
from demandloom.plans.requests import ForecastRequest, PlanRequest, ScenarioRequest, shock_table
from demandloom.schemas import FORECAST_POINT
from demandloom.sources.datasets import DatasetNotFound, Datasets
from demandloom.sources.files import read_csv
from demandloom.sources.store import ResultNotFound, ResultStore, new_id
from demandloom.sources.watch import BAD_VALUES, Watch

HEADERS = {
    "forecasts": (
        "model_name string, model_version string, components array<string>, notes string, sales_rows bigint, "
        "unreadable_dates bigint, unreadable_quantities bigint, created_at timestamp, forecast_id string"
    ),
    "plans": "forecast_id string, location string, created_at timestamp, plan_id string",
    "scenarios": (
        "forecast_id string, plan_id string, name string, kpi string, base double, scenario double, delta double, "
        "unit string, factor double, narrative string, created_at timestamp, scenario_id string"
    ),
}


def forecast_fits(
    sales: DataFrame,
    request: ForecastRequest,
    signals: DataFrame | None = None,
    partitions: int | None = None,
    stored: Callable[[DataFrame], DataFrame] = lambda series: series,
) -> tuple[DataFrame, DataFrame | None]:
    """Fit table of a request over harmonised sales, and its (sku, seq) lines.

    Pooled trees read the series three times, so `stored` is asked to write them first.
    """
    spark = sales.sparkSession
    requested = request.skus
    if isinstance(requested, list):
        requested = requested_skus(spark, requested)
    daily = daily_demand(sales, signals, requested, request.location)
    if request.resample and request.granularity != "D":
        daily = whole_periods(resample(daily, request.granularity))
    series = pack_series(daily, requested, partitions)
    steps = horizon(request.start_date, request.end_date, request.granularity)
    if request.pooled_trees:
        series = stored(series)
    return forecast.fit_models(series, steps, request.forced_model, pooled=request.pooled_trees), requested


def _one_way(on_unreadable: str) -> None:
    if on_unreadable not in ("raise", "keep"):
        raise ValueError(f"on_unreadable must be 'raise' or 'keep', not {on_unreadable!r}")


class PlanningFlow:
    def __init__(self, spark: SparkSession, data_root: str, result_root: str):
        self.spark = spark
        self.datasets = Datasets(spark, data_root)
        self.store = ResultStore(spark, result_root)

    # --- inputs

    def sales(self) -> DataFrame:
        return harmonize_sales(self.datasets.read("sales"))

    def watched_sales(self) -> tuple[DataFrame, Watch]:
        """Sales, and the counts of what cannot be read, which the job that uses them fills."""
        watch = Watch("sales")
        return harmonize_sales(self.datasets.read("sales"), watch=watch), watch

    def signals(self) -> DataFrame:
        return self.datasets.read("external_signals")

    def watched_signals(self) -> tuple[DataFrame, Watch]:
        watch = Watch("external_signals")
        return self.datasets.read("external_signals", watch), watch

    def _judged(self, watches: list[Watch], on_unreadable: str, run_id: str | None = None) -> None:
        """Raises if a job met values that it could not read, or keeps their counts in `bad_rows`."""
        if on_unreadable == "raise":
            for watch in watches:
                bad = {column: n for column, (n, _) in watch.bad().items()}
                if bad and watch.dataset == "sales":
                    raise UnreadableSales(
                        f"{bad.get('date', 0)} dates and {bad.get('quantity', 0)} quantities of {watch.rows} sales cannot be read"
                    )
                watch.check()
        elif any(watch.bad() for watch in watches):
            tables = [watch.table(self.spark) for watch in watches]
            rows = tables[0]
            for more in tables[1:]:
                rows = rows.unionByName(more)
            self.store.save("bad_rows", rows, "run_id", run_id or new_id())

    def bad_rows(self, run_id: str) -> DataFrame:
        """(dataset, column, bad, example) of a run that kept on with values it could not read."""
        found = self.store.rows("bad_rows", "run_id", run_id)
        return self.spark.createDataFrame([], BAD_VALUES) if found is None else found.drop("run_id")

    def preview(self, kind: str, limit: int = 20, order_by: list[str] | None = None) -> dict:
        """First rows of a dataset with its size, columns, roles and warnings."""
        df = self.datasets.read(kind)
        roles = column_roles(df, with_rows=True).collect()  # a row per column, and one scan for both facts
        fields = "pos int, name string, dtype string, role string"
        return {
            "dataset_type": kind,
            "rows": roles[0]["rows"] if roles else 0,
            "columns": df.columns,
            "preview": preview(df, order_by or df.columns, limit),
            "schema": self.spark.createDataFrame([tuple(r)[:4] for r in roles], fields),
            "warnings": schema_warnings(df.columns, kind),
        }

    def default_request(
        self, order_by: list[str] | None = None, limit: int = 20, preview_rows: int | None = None
    ) -> ForecastRequest | None:
        """Request for the first SKUs and the dates of the sales; None without dates or SKUs.

        `preview_rows` looks at the rows of a preview only, as a form does that has no others.
        """
        sales = self.datasets.read("sales")
        skus = [r.sku for r in default_skus(sales, order_by or sales.columns, limit, preview_rows).orderBy("place").collect()]
        dates = default_dates(sales, order_by, preview_rows).first()
        if not skus or dates.start_date is None:
            return None
        return ForecastRequest(dates.start_date, dates.end_date, skus)

    # --- forecast

    def create_forecast(self, request: ForecastRequest, on_unreadable: str = "raise") -> str:
        """Id of the stored forecast.

        Values that cannot be read would be missing from the series. The job that fits the models
        counts them as it reads sales and signals, and nothing is listed if there are any, unless
        the caller accepts them with `keep`; `bad_rows` then has their counts.
        """
        _one_way(on_unreadable)
        sales, sales_watch = self.watched_sales()
        signals, signals_watch = self.watched_signals()
        forecast_id = new_id()

        def stored(series: DataFrame) -> DataFrame:
            self.store.save("series", series, "forecast_id", forecast_id)
            return self.store.load("series", "forecast_id", forecast_id).drop("forecast_id")

        # Series are dealt to as many partitions as the store has buckets, so fits are written as they come.
        fits, requested = forecast_fits(sales, request, signals, self.store.buckets, stored)
        self.store.save_by_sku("fits", fits, "forecast_id", forecast_id, dealt=not request.pooled_trees)
        self._judged([sales_watch, signals_watch], on_unreadable, forecast_id)
        fits = self.store.by_sku("fits", "forecast_id", forecast_id)
        if fits is not None:
            points = forecast.forecast_points(fits, requested)
            self.store.save_by_sku("points", points, "forecast_id", forecast_id)
        # The header comes last: a forecast is listed only once it is whole.
        meta = forecast.METADATA
        bad = {column: n for column, (n, _) in sales_watch.bad().items()}
        header = self.spark.range(1).select(
            F.lit(meta["model_name"]).alias("model_name"), F.lit(meta["model_version"]).alias("model_version"),
            F.array(*map(F.lit, meta["components"])).alias("components"), F.lit(meta["notes"]).alias("notes"),
            F.lit(sales_watch.rows).cast("bigint").alias("sales_rows"), F.lit(bad.get("date", 0)).cast("bigint").alias("unreadable_dates"),
            F.lit(bad.get("quantity", 0)).cast("bigint").alias("unreadable_quantities"),
            F.current_timestamp().alias("created_at"),
        )
        self.store.add_header("forecasts", header, "forecast_id", forecast_id)
        return forecast_id

    def points(self, forecast_id: str) -> DataFrame:
        self.store.one("forecasts", "forecast_id", forecast_id)
        rows = self.store.by_sku("points", "forecast_id", forecast_id)
        if rows is None:
            return self.spark.createDataFrame([], FORECAST_POINT)
        return rows.select(*FORECAST_POINT.fieldNames())

    def fits(self, forecast_id: str) -> DataFrame:
        self.store.one("forecasts", "forecast_id", forecast_id)
        fits = self.store.by_sku("fits", "forecast_id", forecast_id)
        return self.store.load("fits", "forecast_id", forecast_id) if fits is None else fits

    def metrics(self, forecast_id: str) -> DataFrame:
        return forecast.metrics(self.fits(forecast_id))

    # --- plan

    def create_plan(self, request: PlanRequest) -> str:
        plan_id = new_id()
        points = self.points(request.forecast_id)
        required = supply.requirements(
            supply.demand_summary(points), request.target_service_level, request.lead_time_days
        )
        self.store.save("orders", supply.orders(required, request.location), "plan_id", plan_id)
        self.store.save("production", supply.production(required), "plan_id", plan_id)
        self.store.save("plan_kpis", supply.plan_kpis(required, request.target_service_level), "plan_id", plan_id)
        header = self.spark.range(1).select(
            F.lit(request.forecast_id).alias("forecast_id"), F.lit(request.location).cast("string").alias("location"),
            F.current_timestamp().alias("created_at"),
        )
        self.store.add_header("plans", header, "plan_id", plan_id)
        return plan_id

    def plan_table(self, table: str, plan_id: str) -> DataFrame | None:
        """`orders`, `production` or `plan_kpis` of a plan; None if no plan has such rows."""
        self.store.one("plans", "plan_id", plan_id)
        return self.store.rows(table, "plan_id", plan_id)

    # --- scenario

    def run_scenario(self, request: ScenarioRequest) -> str:
        scenario_id = new_id()
        asked = self.spark.createDataFrame(
            [(scenario_id, request.forecast_id, request.plan_id, request.name)],
            "scenario_id string, forecast_id string, plan_id string, name string",
        )
        plans = self.headers("plans").select("plan_id", "forecast_id", F.col("created_at").alias("seq"))
        based = scenario.base_plans(asked, plans)
        base_plan, status = based.select("base_plan_id", "status").first()
        if status == "plan_not_found":
            raise ResultNotFound(f"plan {request.plan_id!r} not found")
        if status == "no_base_plan":
            raise ValueError("no base plan available for the scenario")
        lines = [self.store.rows(t, "plan_id", base_plan) for t in ("orders", "production")]
        empty = self.spark.createDataFrame([], "plan_id string, quantity double")
        volumes = scenario.plan_volumes(*[empty if part is None else part for part in lines])
        shocks = shock_table(self.spark, scenario_id, request.shocks)
        result = scenario.narratives(scenario.scenario_kpis(based, volumes, shocks)).select(
            "forecast_id", F.col("base_plan_id").alias("plan_id"), "name", "kpi", "base", "scenario", "delta", "unit",
            "factor", "narrative", F.current_timestamp().alias("created_at"),
        )
        self.store.add_header("scenarios", result, "scenario_id", scenario_id)
        return scenario_id

    def scenarios(self, forecast_id: str | None = None, plan_id: str | None = None) -> DataFrame:
        return scenario.list_scenarios(self.headers("scenarios"), forecast_id, plan_id)

    def scenario(self, scenario_id: str) -> DataFrame:
        return self.store.one("scenarios", "scenario_id", scenario_id)

    # --- explanation and reports

    def explain(self, forecast_id: str, on_unreadable: str = "raise") -> dict[str, DataFrame]:
        _one_way(on_unreadable)
        points = self.points(forecast_id)
        text = None
        try:
            signals, watch = self.watched_signals()
            text = explain.signal_summary(signals).first().summary
            self._judged([watch], on_unreadable)
        except DatasetNotFound:
            pass
        summary = self.spark.createDataFrame([(text,)], "summary string")
        return {
            "global_importance": explain.global_drivers(self.spark),
            "by_sku": explain.drivers_by_sku(points),
            "external_summary": summary,
        }

    def headers(self, table: str) -> DataFrame:
        saved = self.store.headers(table, f"{table.removesuffix('s')}_id")
        return self.spark.createDataFrame([], HEADERS[table]) if saved is None else saved

    def forecast_summary(self, forecast_id: str | None = None) -> str:
        header = reports.latest(self.headers("forecasts"), "forecast_id", forecast_id)
        row = header.first()
        if row is None:
            return "No forecasts are available in the current session."
        fits = self.store.by_sku("fits", "forecast_id", row.forecast_id)
        models = self.spark.createDataFrame([], "sku string, model string, seq string")
        if fits is not None:
            models = fits.select("sku", "model", F.col("sku").alias("seq"))
        return reports.forecast_text(header, self.points(row.forecast_id), models).first().text

    def plan_summary(self, plan_id: str | None = None) -> str:
        row = reports.latest(self.headers("plans"), "plan_id", plan_id).first()
        if row is None:
            return "No plans are available in the current session."
        text = f"Plan {row.plan_id} is linked to forecast {row.forecast_id}."
        kpis = self.store.rows("plan_kpis", "plan_id", row.plan_id)
        line = None if kpis is None else reports.plan_kpi_text(kpis).first()
        return text if line is None else f"{text} {line.text}"

    def scenario_summary(self, scenario_id: str | None = None) -> str:
        saved = self.headers("scenarios")
        if scenario_id is not None:
            chosen = reports.scenario_text(saved.where(F.col("scenario_id") == scenario_id)).first()
            if chosen is not None:
                return chosen.text
        return reports.scenario_overview(saved, order="created_at").first().text

    def dataset_summary(self, kind: str) -> str:
        found = self.datasets.location(kind)
        if found is None:
            return f"Dataset {kind} is not available."
        name = f"{kind}.csv" if found[0] == "uploaded" else f"sample_{kind}.csv"
        return profile_text(dataset_profile(self.datasets.read(kind)), kind, name).first().text

    def session_counts(self) -> DataFrame:
        return reports.session_counts(**{t: self.headers(t) for t in ("forecasts", "plans", "scenarios")})

    # --- monitoring and training

    def _naive_mean(self, on_unreadable: str) -> Row:
        _one_way(on_unreadable)
        sales, sales_watch = self.watched_sales()
        signals, signals_watch = self.watched_signals()
        row = monitor.train_naive_mean(sales, signals).first()
        self._judged([sales_watch, signals_watch], on_unreadable)
        return row

    def monitor(self, on_unreadable: str = "raise") -> dict:
        return {"metric": "naive_mape", "value": self._naive_mean(on_unreadable).value}

    def train(self, on_unreadable: str = "raise") -> None:
        """Fit the naive mean and log its error; a retraining job calls this again."""
        row = self._naive_mean(on_unreadable)
        self.store.log_run(self.spark.createDataFrame([row], "model_type string, metric string, value double, artifact string"))

    def retrain(self, files: str, on_unreadable: str = "raise") -> dict:
        """Train on all sales files that the pattern names, reading only those that are new or have changed.

        What training needs of a file is kept under the file's path, size and time, one state for each. A
        corrected file thus replaces what it said before, and a file that is gone no longer counts. A
        file whose values cannot be read raises before its state counts. States are written one by
        one, so a run that broke off goes on where it stopped. Returns the record and the files read.
        """
        _one_way(on_unreadable)
        stamps = self.store.stamps(files)
        if not stamps:
            raise DatasetNotFound(f"no files at {files!r}")
        known, read = self.store.known_states(), []
        for path, key in stamps.items():
            if key in known:
                continue
            watch = Watch("sales")
            sales = harmonize_sales(read_csv(self.spark, path), watch=watch)
            # Kept rows wait for the judgement: a state counts once its folder has its mark of success.
            state = monitor.demand_state(sales, F.lit(path))
            rows = state.persist()
            try:
                rows.count()
                self._judged([watch], on_unreadable, key)
                self.store.save_state(rows, key)
            finally:
                rows.unpersist()
            read.append(path)
        signals, signals_watch = self.watched_signals()
        record = monitor.training_record(monitor.naive_mape_of_state(self.store.states(list(stamps.values())), signals)).first()
        self._judged([signals_watch], on_unreadable)
        self.store.log_run(self.spark.createDataFrame([record], "model_type string, metric string, value double, artifact string"))
        return {**record.asDict(), "files_read": read}
