"""Every operator as a query over a star schema of orders; see `sources.star_views`.

Each query takes (spark, folder) and covers the whole tables. `star_sql` holds the same
queries in plain SQL, for checking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.functions.dates import horizon
from demandloom.functions.names import dataset_kind_from_file
from demandloom.operators import catalog as cat
from demandloom.operators import enrich, explain, forecast, history, monitor, pooled, profile, reports, scenario, supply
from demandloom.operators.harmonize import harmonize_sales, unreadable_sales
from demandloom.schemas import KINDS
from demandloom.sources.files import typed, unreadable_rows
from demandloom.sources.infer import infer_types
from demandloom.sources.star_views import StarViews, part_sku
from demandloom.streaming.publish import as_events

START, END = "2001-11-05", "2001-12-04"
LOCATION = "ASIA"

# Column names as files spell them; a dataset's columns are drawn from these by part key.
HEADERS = [
    "Order_Date", "Product", "Region", "Qty", "unit price", "stock level", "SKU", "Store",
    "Item_Qty", "updated_by", "eta date", "Supplier", "PO_ID", "Line ID", "capacity", "UOM",
    "Category", "Description", "date", "location", "order-date", "Trend Index", "Customer", "Amount",
]
FILE_WORDS = [
    "Sales", "sell-through", "stock", "Inventory", "production", "manufacturing", "purchase", "po_",
    "vendor", "master", "Catalog", "signal", "external", "macro", "notes",
]
PLAN_TYPES = ["ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE", "NONE"]
SCORE_DIGITS = 6
# Closed-form predictors that stand in for the fitted models, with their metric prefix and code.
STAND_INS = {"mean": "mean", "last": "last", "max": "max"}
STAND_IN_CODES = {"stub": 0.0, "mean": 1.0, "last": 2.0, "max": 3.0}

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = lambda spark, folder: fn(StarViews(spark, folder))
    return fn


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _rounded_signals(df: DataFrame) -> DataFrame:
    """Temperatures get more digits, as averages of few amounts end in exact halves."""
    return rounded(df.withColumn("temperature", F.round("temperature", 8).cast("decimal(20,8)")), 6).withColumn(
        "temperature", F.col("temperature").cast("double")
    )


def _pick(words: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(number, F.lit(len(words))) + 1).cast("int"))


def _steps() -> Column:
    return horizon(START, END)


def _brand_points(v: StarViews) -> DataFrame:
    return forecast.baseline_points(history.daily_demand(v.brand_sales()), _steps())


def _part_points(v: StarViews) -> DataFrame:
    return forecast.baseline_points(history.daily_demand(v.part_sales()), _steps())


def _span() -> Column:
    """The horizon's ends, known from the request; saves a scan of the points."""
    return F.struct(F.to_date(F.lit(START)).alias("first"), F.to_date(F.lit(END)).alias("last"))


def _catalog(v: StarViews) -> DataFrame:
    return v.table("lineitem").select(
        F.concat(F.lit("DS-"), F.col("l_orderkey").cast("string")).alias("dataset"),
        _pick(list(KINDS), F.col("l_orderkey")).alias("kind"),
        F.col("l_linenumber").alias("pos"),
        _pick(HEADERS, F.col("l_partkey")).alias("column"),
    )


# --- datasets


@query
def harmonized_sales(v: StarViews) -> DataFrame:
    return harmonize_sales(v.raw_sales())


@query
def unreadable_values(v: StarViews) -> DataFrame:
    raw = v.raw_sales()
    return unreadable_sales(
        raw.withColumns(
            {
                "Order_Date": F.when(F.col("Line") == 7, F.lit("unknown")).otherwise(F.col("Order_Date")),
                "Order Qty": F.when(F.col("Order Qty") == "13.0", F.lit("a dozen")).otherwise(F.col("Order Qty")),
            }
        )
    )


@query
def guess_columns(v: StarViews) -> DataFrame:
    return cat.guess_columns(_catalog(v))


@query
def required_columns(v: StarViews) -> DataFrame:
    missing = cat.missing_columns(_catalog(v))
    return missing.withColumn("warning", cat.missing_warning(F.col("kind"), F.col("missing")))


@query
def dataset_kind(v: StarViews) -> DataFrame:
    return cat.dataset_kinds(_catalog(v))


@query
def file_kind(v: StarViews) -> DataFrame:
    name = F.concat_ws("_", _pick(FILE_WORDS, F.col("p_partkey")), F.regexp_replace("p_name", " ", "-"), F.lit("2024.csv"))
    return v.table("part").select("p_partkey", name.alias("file_name")).withColumn(
        "kind", dataset_kind_from_file(F.col("file_name"))
    )


@query
def column_roles(v: StarViews) -> DataFrame:
    return profile.column_roles(v.raw_sales())


@query
def dataset_preview(v: StarViews) -> DataFrame:
    return profile.preview(v.sales(), ["date", "sku", "location", "quantity"])


@query
def dataset_profile(v: StarViews) -> DataFrame:
    return profile.dataset_profile(v.sales())


@query
def merged_profile(v: StarViews) -> DataFrame:
    """The profile of all sales from the sketches of one upload per year, and whether its number of SKUs is within 4 %."""
    sales = v.located_part_sales().withColumn("upload", F.year("date"))
    own = sales.groupBy("upload").agg(
        F.count(F.lit(1)).alias("rows"), F.lit(0).alias("unreadable"), F.min("date").alias("first"), F.max("date").alias("last"),
        F.hll_sketch_agg("sku", profile.SKETCH_BITS).alias("skus"), F.hll_sketch_agg("location", profile.SKETCH_BITS).alias("locations"),
    )
    exact = sales.agg(F.count_distinct("sku")).scalar()
    return profile.merged_profile(own).select(
        "uploads", "rows", (F.abs(F.col("skus") - exact) <= 0.04 * exact).alias("skus_close"), "locations", "first_date", "last_date"
    )


@query
def default_skus(v: StarViews) -> DataFrame:
    return profile.default_skus(v.raw_sales(), ["Invoice", "Line"])


@query
def default_dates(v: StarViews) -> DataFrame:
    return profile.default_dates(v.raw_sales())


@query
def preview_defaults(v: StarViews) -> DataFrame:
    """SKUs and dates that a form takes from a preview of 20 rows, the feature being that it sees no others."""
    order = ["Invoice", "Line", "Product ID", "Order Qty"]
    dates = profile.default_dates(v.raw_sales(), order, 20)
    span = dates.select(F.struct("start_date", "end_date").alias("d")).scalar()
    return profile.default_skus(v.raw_sales(), order, 20, 20).select("place", "sku", span["start_date"].alias("start_date"), span["end_date"].alias("end_date"))


# --- signals


def _text_signals(v: StarViews) -> DataFrame:
    """Signals as a file holds them: all as text, holidays as True and False."""
    signals = v.signals()
    holiday = F.when(F.col("is_holiday") == 1, "True").otherwise("False").alias("is_holiday")
    return signals.select(F.col("date").cast("string").alias("date"), "location", holiday, *[F.col(c).cast("string").alias(c) for c in signals.columns[3:]])


@query
def typed_signals(v: StarViews) -> DataFrame:
    return _rounded_signals(typed(_text_signals(v), "external_signals"))


def _bad_text_signals(v: StarViews) -> DataFrame:
    """The same with values that no one can read, where the day or the region says so."""
    broken = {
        "date": F.when(F.dayofmonth("date") == 31, F.concat(F.lit("31st of "), F.date_format("date", "MMM yyyy"))),
        "is_holiday": F.when((F.col("location") == LOCATION) & (F.dayofmonth("date") == 1), F.lit("maybe")),
        "price": F.when(F.dayofmonth("date") == 2, F.lit("12,50")),
    }
    text = _text_signals(v).withColumn("day", F.to_date("date"))
    shown = [F.coalesce(broken[c].alias(c), F.col(c)).alias(c) if c in broken else F.col(c) for c in text.columns if c != "day"]
    return text.withColumn("date", F.col("date").cast("string")).select("day", *shown)


@query
def bad_signals(v: StarViews) -> DataFrame:
    """Signals set apart because a value of theirs cannot be read."""
    return unreadable_rows(_bad_text_signals(v), "external_signals").select("day", "location", "unreadable")


@query
def inferred_types(v: StarViews) -> DataFrame:
    """Types of the raw sales' columns and of some that are mixed, flags, keys or empty."""
    line = F.col("Line")
    raw = v.raw_sales().withColumns(
        {
            "Rush": F.when(line % 2 == 0, "True").otherwise("FALSE"),
            "Mixed": F.when(line == 7, F.col("Region")).otherwise(F.col("Order Qty")),
            "Zeros": F.concat(F.lit("00"), line.cast("string")),
            "Empty": F.lit(None).cast("string"),
            "Change": F.when(line > 2, F.concat(F.lit("-"), line.cast("string"), F.lit("e-2"))),
            "Shipped": F.col("Order_Date"),
        }
    )
    return infer_types(raw)


@query
def sales_with_signals(v: StarViews) -> DataFrame:
    return _rounded_signals(enrich.attach_signals(v.sales(), v.signals()))


@query
def signals_filled(v: StarViews) -> DataFrame:
    return _rounded_signals(enrich.sales_with_signals(v.sales(), v.signals()))


@query
def repeated_signal_keys(v: StarViews) -> DataFrame:
    return enrich.repeated_signal_keys(v.order_signals())


@query
def signal_summary(v: StarViews) -> DataFrame:
    return explain.signal_summary(v.signals(), days=14)


@query
def signal_facts(v: StarViews) -> DataFrame:
    return rounded(explain.recent_signals(v.signals(), days=60, location=LOCATION))


# --- history and horizon


@query
def daily_demand(v: StarViews) -> DataFrame:
    return history.daily_demand(v.part_sales())


@query
def daily_demand_repeated_signals(v: StarViews) -> DataFrame:
    return history.daily_demand(v.sales(), v.order_signals())


@query
def location_fallback(v: StarViews) -> DataFrame:
    return history.daily_demand(v.located_part_sales(), location=LOCATION)


@query
def resampled_week(v: StarViews) -> DataFrame:
    return history.resample(history.daily_demand(v.part_sales()), "W")


@query
def resampled_month(v: StarViews) -> DataFrame:
    return history.resample(history.daily_demand(v.part_sales()), "M")


@query
def whole_weeks(v: StarViews) -> DataFrame:
    """Weekly history as a forecast by week takes it."""
    return history.whole_periods(history.resample(history.daily_demand(v.brand_sales()), "W"))


@query
def event_demand(v: StarViews) -> DataFrame:
    return rounded(history.daily_demand(v.event_sales()))


def _horizon_query(v: StarViews, granularity: str) -> DataFrame:
    spans = v.brand_sales().groupBy("sku").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return spans.select("sku", F.explode(horizon(F.col("first"), F.col("last"), granularity)).alias("date"))


@query
def horizon_day(v: StarViews) -> DataFrame:
    return _horizon_query(v, "D")


@query
def horizon_week(v: StarViews) -> DataFrame:
    return _horizon_query(v, "W")


@query
def horizon_month(v: StarViews) -> DataFrame:
    return _horizon_query(v, "M")


# --- forecast


@query
def baseline_forecast(v: StarViews) -> DataFrame:
    return rounded(_part_points(v).select("sku", "date", "mean"))


@query
def forecast_band(v: StarViews) -> DataFrame:
    return rounded(_brand_points(v))


@query
def requested_forecast(v: StarViews) -> DataFrame:
    """Requests of suppliers and customers: some SKUs come several times, some have no sales."""
    buyers = v.table("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").alias("seq")).unionAll(
        v.table("customer").select("c_custkey", -F.col("c_custkey") - 1)
    )
    requested = buyers.select(part_sku(F.pmod(F.col("k") * 37, F.lit(3000))).alias("sku"), F.col("seq").cast("int").alias("seq"))
    daily = history.daily_demand(v.part_sales(), requested=requested)
    fits = forecast.fit_baseline(history.pack_series(daily, requested), _steps())
    return rounded(forecast.forecast_points(fits, requested).select("seq", "sku", "date", "mean"))


def _standin_fits(v: StarViews) -> DataFrame:
    """Scores of three closed-form predictors: the training part's mean, last value and maximum.

    The split, the scores and the choice are those of `fit_models`; the predictors stand in for
    the fitted models, as SQL can state them.
    """
    split = forecast.split_holdout(history.pack_series(history.daily_demand(v.part_sales())))

    def repeat(value: Column) -> Column:
        return F.when(F.col("n_val").isNotNull(), F.transform("holdout", lambda _: value))

    mean = F.aggregate("train", F.lit(0.0), lambda acc, q: acc + q) / F.size("train")
    split = split.withColumns({"p_mean": mean, "p_last": F.element_at("train", -1), "p_max": F.array_max("train")})
    return forecast.score_paths(
        split,
        {
            "mean": repeat(F.col("p_mean")),
            "last": repeat(F.col("p_last")),
            "max": repeat(F.col("p_max")),
        },
    ).withColumn("model", F.coalesce(forecast.best_model(STAND_INS)["model"], F.lit("stub")))


@query
def holdout_split(v: StarViews) -> DataFrame:
    split = forecast.split_holdout(history.pack_series(history.daily_demand(v.part_sales())))
    total = F.aggregate("holdout", F.lit(0.0), lambda acc, q: acc + q)
    return split.select(
        "sku", "history", "n_val", F.size("train").alias("train_points"),
        F.array_max("train_dates").alias("train_end"), F.get("holdout_dates", F.lit(0)).alias("holdout_start"),
        total.alias("holdout_total"),
    )


@query
def naive_scores(v: StarViews) -> DataFrame:
    names = [f"{m}_{kind}" for m in STAND_INS for kind in ("mape", "mae")]
    return rounded(_standin_fits(v).select("sku", *names), SCORE_DIGITS)


@query
def model_select(v: StarViews) -> DataFrame:
    return _standin_fits(v).select("sku", "model", forecast.model_code(F.col("model"), STAND_IN_CODES).alias("code"))


@query
def metric_map(v: StarViews) -> DataFrame:
    return rounded(forecast.metrics(_standin_fits(v), STAND_INS, STAND_IN_CODES), SCORE_DIGITS)


@query
def best_score(v: StarViews) -> DataFrame:
    return rounded(reports.best_scores(_standin_fits(v), STAND_INS), SCORE_DIGITS)


@query
def model_counts(v: StarViews) -> DataFrame:
    return reports.model_counts(_standin_fits(v))


@query
def forced_stub_forecast(v: StarViews) -> DataFrame:
    """Forcing the baseline on every brand."""
    series = history.pack_series(history.daily_demand(v.brand_sales()))
    return rounded(forecast.forecast_points(forecast.fit_models(series, _steps(), "baseline")))


def _short_sales(v: StarViews) -> DataFrame:
    """Sales by part and nation of the supplier: many series of fewer than four days."""
    supplied = v._sold().join(v.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    sku = F.concat_ws("-", part_sku(F.col("l_partkey")), "s_nationkey").alias("sku")
    return supplied.select("date", sku, "quantity")


@query
def fallback_forecast(v: StarViews) -> DataFrame:
    """First and last day of the series that are too short for any model, under the automatic choice."""
    series = history.pack_series(history.daily_demand(_short_sales(v))).where(F.size("quantities") < forecast.LEAST_HISTORY)
    points = forecast.forecast_points(forecast.fit_models(series, _steps()))
    ends = points.groupBy("sku").agg(F.min_by("mean", "date").alias("first_mean"), F.max_by("mean", "date").alias("last_mean"))
    return rounded(ends)


@query
def forced_contract(v: StarViews) -> DataFrame:
    """What holds for each forced model on every short series: it is skipped below its least history, and never falls below 0."""
    series = history.pack_series(history.daily_demand(_short_sales(v)))
    rows = None
    for name in forecast.MODELS:
        fits = forecast.fit_models(series, _steps(), name)
        part = fits.select(
            "sku", F.lit(name).alias("forced"), "model", F.coalesce(F.size("path"), F.lit(0)).alias("steps"),
            F.coalesce(F.forall("path", lambda q: q >= 0), F.lit(True)).alias("not_below_zero"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query
def fit_contract(v: StarViews) -> DataFrame:
    """What holds for the fits of every brand, whatever the models say."""
    fits = _auto_fits(v, v.brand_sales())
    mapes = [F.col(f"{prefix}_mape") for prefix in forecast.MODELS.values()]
    scores = [F.col(f"{prefix}_{kind}").isNotNull().cast("int") for prefix in forecast.MODELS.values() for kind in ("mape", "mae")]
    of_chosen = F.coalesce(*[F.when(F.col("model") == m, F.col(f"{prefix}_mape")) for m, prefix in forecast.MODELS.items()])
    checked = fits.select(
        "sku", "history", F.size("horizon").alias("steps"), sum(scores, F.lit(0)).alias("scores"),
        (of_chosen == F.least(*mapes)).alias("least_mape"), (F.size("path") == F.size("horizon")).alias("whole_path"),
    )
    bands = forecast.forecast_points(fits).groupBy("sku").agg(
        F.bool_and((F.abs(F.col("q10") - 0.8 * F.col("mean")) < 1e-9) & (F.abs(F.col("q90") - 1.2 * F.col("mean")) < 1e-9)).alias("band"),
        F.count("*").alias("points"),
    )
    return checked.join(bands, "sku")


def _auto_fits(v: StarViews, sales: DataFrame) -> DataFrame:
    return forecast.fit_models(history.pack_series(history.daily_demand(sales)), _steps())


@query
def lag_rows(v: StarViews) -> DataFrame:
    """What the pooled trees learn from: every part's days with the day before."""
    return rounded(pooled.lag_rows(history.pack_series(history.daily_demand(v.part_sales()))), 6)


def _pooled_paths(v: StarViews, sales: DataFrame) -> DataFrame:
    series = history.pack_series(history.daily_demand(sales))
    trees = pooled.fit_pooled(series)
    return series.select("sku", F.size("quantities").alias("history"), trees.path(F.col("quantities"), F.size(_steps())).alias("path"))


@query
def pooled_forecast(v: StarViews) -> DataFrame:
    """Every part's demand by one set of trees; parts of fewer than six days have none."""
    paths = _pooled_paths(v, v.part_sales()).where("path IS NOT NULL").withColumn("horizon", _steps())
    steps = paths.select("sku", F.inline(F.arrays_zip("horizon", "path")))
    return steps.select("sku", F.col("horizon").alias("date"), F.col("path").alias("mean"))


@query
def pooled_contract(v: StarViews) -> DataFrame:
    """What holds for the pooled paths of every short series, whatever the trees say."""
    paths = _pooled_paths(v, _short_sales(v))
    return paths.select(
        "sku", "history", F.coalesce(F.size("path"), F.lit(0)).alias("steps"),
        F.coalesce(F.forall("path", lambda q: q >= 0), F.lit(True)).alias("not_below_zero"),
    )


@query
def auto_forecast(v: StarViews) -> DataFrame:
    return forecast.forecast_points(_auto_fits(v, v.brand_sales()))


@query
def auto_forecast_parts(v: StarViews) -> DataFrame:
    return forecast.forecast_points(_auto_fits(v, v.part_sales()))


@query
def auto_metrics(v: StarViews) -> DataFrame:
    return forecast.metrics(_auto_fits(v, v.brand_sales()))


@query
def auto_plan(v: StarViews) -> DataFrame:
    points = forecast.forecast_points(_auto_fits(v, v.brand_sales()))
    return supply.requirements(supply.demand_summary(points, _span()))


# --- supply plan


@query
def demand_summary(v: StarViews) -> DataFrame:
    return rounded(supply.demand_summary(_part_points(v)))


def _required(v: StarViews, **kwargs) -> DataFrame:
    return supply.requirements(supply.demand_summary(_part_points(v), _span()), **kwargs)


@query
def safety_stock(v: StarViews) -> DataFrame:
    """Service level and lead time differ by part."""
    constraints = v.table("part").select(
        part_sku(F.col("p_partkey")).alias("sku"),
        F.when(F.col("p_size") > 25, F.lit(0.97)).otherwise(F.lit(0.9)).alias("target_service_level"),
        F.col("p_size").alias("lead_time_days"),
    )
    return rounded(_required(v, constraints=constraints).select("sku", "demand", "safety_stock", "required"))


@query
def supply_plan(v: StarViews) -> DataFrame:
    required = _required(v)
    buy, make = supply.orders(required, LOCATION), supply.production(required)
    lines = buy.select(
        "sku", F.col("order_type").alias("line"), "location", F.col("order_date").alias("date"), "quantity"
    ).unionAll(
        make.select("sku", "line_id", F.lit(None).cast("string"), F.col("production_date"), "quantity")
    )
    return rounded(lines)


@query
def plan_kpis(v: StarViews) -> DataFrame:
    return rounded(supply.plan_kpis(_required(v)), 2)


def _plan_lines(v: StarViews) -> DataFrame:
    """Required quantities in one plan per brand and part type."""
    parts = v.table("part").select(
        part_sku(F.col("p_partkey")).alias("sku"),
        F.concat_ws("-", F.lit("PLAN"), "p_brand", "p_type").alias("plan_id"),
    )
    return _required(v).join(parts, "sku")


def _plans(v: StarViews) -> DataFrame:
    return v.table("part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("seq")).select(
        F.concat_ws("-", F.lit("PLAN"), "p_brand", "p_type").alias("plan_id"),
        F.concat(F.lit("FC-"), "p_brand").alias("forecast_id"), "seq",
    )


@query
def kpi_lookup(v: StarViews) -> DataFrame:
    kpis = supply.plan_kpis(_plan_lines(v), by=("plan_id",))
    return rounded(reports.kpi_lookup(kpis, ("plan_id",)), 2)


@query
def plan_summary(v: StarViews) -> DataFrame:
    return reports.plan_kpi_text(supply.plan_kpis(_plan_lines(v), by=("plan_id",)))


@query
def latest_plan(v: StarViews) -> DataFrame:
    return reports.latest(_plans(v), "plan_id", order=("seq",))


# --- scenarios


def _scenarios(v: StarViews) -> DataFrame:
    """One scenario per order. Some name a plan, some a plan that does not exist, some none."""
    key = F.col("o_orderkey")
    named = F.concat(
        F.lit("PLAN-Brand#"), (F.pmod("o_custkey", F.lit(25)) + 1).cast("string"), F.lit("-"), _pick(PLAN_TYPES, key)
    )
    return v.table("orders").select(
        F.concat(F.lit("SCN-"), key.cast("string")).alias("scenario_id"),
        F.concat(F.lit("FC-Brand#"), (F.pmod("o_custkey", F.lit(27)) + 1).cast("string")).alias("forecast_id"),
        F.when(key % 3 == 0, named).when(key % 3 == 1, F.lit("")).alias("plan_id"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("name"),
        key.alias("seq"),
    )


def _shocks(v: StarViews) -> DataFrame:
    return v.table("lineitem").select(
        F.concat(F.lit("SCN-"), F.col("l_orderkey").cast("string")).alias("scenario_id"),
        F.when(F.col("l_returnflag") == "R", F.lit("supply")).otherwise(F.lit("demand")).alias("type"),
        (F.lit(0.7503) + F.col("l_discount") * 5.0).alias("factor"),
    )


def _scenario_kpis(v: StarViews) -> DataFrame:
    lines = _plan_lines(v)
    volumes = scenario.plan_volumes(
        lines.select("plan_id", F.col("purchase").alias("quantity")),
        lines.select("plan_id", F.col("production").alias("quantity")),
    )
    return scenario.scenario_kpis(scenario.base_plans(_scenarios(v), _plans(v)), volumes, _shocks(v))


@query
def scenario_base_plan(v: StarViews) -> DataFrame:
    return scenario.base_plans(_scenarios(v), _plans(v)).select("scenario_id", "base_plan_id", "status")


@query
def scenario_kpis(v: StarViews) -> DataFrame:
    # Mean factors of few shocks end in exact halves at fewer digits.
    kpis = _scenario_kpis(v).withColumn("factor", F.round("factor", 8).cast("decimal(12,8)"))
    kept = kpis.select("scenario_id", "base_plan_id", "kpi", "factor", "base", "scenario", "delta", "unit")
    return rounded(kept).withColumn("factor", F.col("factor").cast("double"))


@query
def delta_percent(v: StarViews) -> DataFrame:
    return rounded(scenario.delta_percent(_scenario_kpis(v)).select("scenario_id", "delta_percent"))


@query
def scenario_narrative(v: StarViews) -> DataFrame:
    return scenario.narratives(_scenario_kpis(v)).select("scenario_id", "narrative")


@query
def scenario_list(v: StarViews) -> DataFrame:
    return scenario.list_scenarios(_scenarios(v), forecast_id="FC-Brand#7")


@query
def scenario_overview(v: StarViews) -> DataFrame:
    return reports.scenario_overview(_scenarios(v))


@query
def scenario_text(v: StarViews) -> DataFrame:
    return reports.scenario_text(scenario.narratives(_scenario_kpis(v)))


@query
def session_counts(v: StarViews) -> DataFrame:
    forecasts = v.table("part").select("p_brand").distinct()
    return reports.session_counts(forecasts=forecasts, plans=_plans(v), scenarios=_scenarios(v))


# --- explanation and reports


@query
def drivers_by_sku(v: StarViews) -> DataFrame:
    return rounded(explain.importance_percent(explain.drivers_by_sku(v.part_sales())))


@query
def top_skus(v: StarViews) -> DataFrame:
    return rounded(reports.top_skus(_part_points(v)))


@query
def demand_by_date(v: StarViews) -> DataFrame:
    return rounded(reports.totals_by_date(_part_points(v)), 2)


@query
def first_periods(v: StarViews) -> DataFrame:
    sold = v.part_sales().select("date", *[F.col("quantity").alias(c) for c in ("mean", "q10", "q90")])
    return reports.first_periods(reports.totals_by_date(sold))


@query
def demand_pivot(v: StarViews) -> DataFrame:
    return rounded(reports.pivot_by_sku(_brand_points(v)))


@query
def demand_long(v: StarViews) -> DataFrame:
    """The pivot in long form, over every part."""
    return rounded(reports.mean_by_sku_and_date(_part_points(v)))


@query
def band_limits(v: StarViews) -> DataFrame:
    return rounded(reports.band_limits(reports.totals_by_date(_part_points(v))), 2)


@query
def forecast_totals(v: StarViews) -> DataFrame:
    return rounded(reports.forecast_totals(_part_points(v)), 2)


@query
def forecast_summary(v: StarViews) -> DataFrame:
    header = v.spark.range(1).select(
        F.lit("FC-1").alias("forecast_id"), F.lit(forecast.METADATA["model_name"]).alias("model_name"),
        F.lit(forecast.METADATA["model_version"]).alias("model_version"),
    )
    models = _standin_fits(v).select("sku", "model", F.col("sku").alias("seq"))
    return reports.forecast_text(header, _part_points(v), models)


@query
def naive_mape(v: StarViews) -> DataFrame:
    return rounded(monitor.naive_mape(v.part_sales()))


def _states(v: StarViews) -> DataFrame:
    """Sales in one source per brand, read twice: at first with other quantities, then corrected."""
    first = monitor.demand_state(v.sales().withColumn("quantity", F.col("quantity") * 3), F.col("sku")).withColumn("read_at", F.lit(1))
    return first.unionByName(monitor.demand_state(v.sales(), F.col("sku")).withColumn("read_at", F.lit(2)))


@query
def training_state(v: StarViews) -> DataFrame:
    return monitor.newest_sources(_states(v)).drop("read_at")


@query
def naive_mape_of_state(v: StarViews) -> DataFrame:
    """The error of `naive_mape_repeated_signals` from states alone."""
    return rounded(monitor.naive_mape_of_state(monitor.newest_sources(_states(v)), v.order_signals()))


@query
def naive_mape_repeated_signals(v: StarViews) -> DataFrame:
    return rounded(monitor.naive_mape(v.sales(), v.order_signals()))


# --- publishing


@query
def published_events(v: StarViews) -> DataFrame:
    """Every event as a JSON message."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return as_events(v.table("events").select("event_id", "user_id", "event_type", day, "value"), "events")
