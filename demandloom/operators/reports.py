"""Control-tower reports over forecast points, fits, plans and scenarios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.text import fixed, grouped_whole
from demandloom.operators.forecast import MODELS

TOP = 5
PERIODS_SHOWN = 30
# SKUs that a pivot may have as columns.
PIVOT_COLUMNS = 1000
KPIS_SHOWN = 6
SCENARIOS_SHOWN = 5
NONE = "—"


def sku_totals(points: DataFrame) -> DataFrame:
    return points.groupBy("sku").agg(F.sum("mean").alias("total"))


def top_skus(points: DataFrame, limit: int = TOP) -> DataFrame:
    """(rank, sku, total, share): largest totals, and their size against the largest."""
    down = F.struct((-F.col("total")).alias("down"), "sku", "total")
    few = sku_totals(points).select(down.alias("r")).orderBy("r").limit(limit)
    listed = few.agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return listed.select(F.get("rows", F.lit(0))["total"].alias("largest"), F.posexplode("rows").alias("place", "r")).select(
        (F.col("place") + 1).alias("rank"), "r.sku", "r.total",
        F.coalesce(F.try_divide("r.total", "largest"), F.lit(0.0)).alias("share"),
    )


def totals_by_date(points: DataFrame) -> DataFrame:
    """(date, label, mean, q10, q90) summed over SKUs; at most one row per period."""
    return points.groupBy("date").agg(
        F.date_format("date", "MM-dd").alias("label"),
        *[F.sum(c).alias(c) for c in ("mean", "q10", "q90")],
    )


def first_periods(by_date: DataFrame, limit: int = PERIODS_SHOWN) -> DataFrame:
    return by_date.orderBy("date").limit(limit)


def mean_by_sku_and_date(points: DataFrame) -> DataFrame:
    """(date, sku, mean): the pivot in long form, for any number of SKUs."""
    return points.groupBy("date", "sku").agg(F.avg("mean").alias("mean"))


def pivot_by_sku(points: DataFrame, skus: list[str] | None = None, most: int = PIVOT_COLUMNS) -> DataFrame:
    """One row per date and one column per SKU with its average mean.

    Without a list, a job of its own finds the SKUs; more than `most` raise, as a table that wide is
    no table (use `mean_by_sku_and_date`). A list must name every SKU, or other SKUs would be lost.
    """
    known = points.select("sku").distinct()
    if skus is None:
        skus = [r.sku for r in known.orderBy("sku").limit(most + 1).collect()]
        if len(skus) > most:
            raise ValueError(f"more than {most} SKUs; use mean_by_sku_and_date")
    else:
        others = known.where(F.col("sku").isNull() | ~F.col("sku").isin(skus)).limit(3).collect()
        if others:
            raise ValueError(f"SKUs not in the list: {[r.sku for r in others]}, and perhaps more")
    return points.groupBy("date").pivot("sku", skus).agg(F.avg("mean"))


def band_limits(by_date: DataFrame) -> DataFrame:
    """One row: extreme band values and the chart axis around them."""
    upper = F.greatest(F.coalesce(F.nullif("q90", F.lit(0.0)), "mean"), F.col("mean"))
    lower = F.least(F.coalesce(F.nullif("q10", F.lit(0.0)), "mean"), F.col("mean"))
    limits = by_date.agg(
        F.coalesce(F.max(upper), F.lit(1.0)).alias("max_band"),
        F.coalesce(F.min(lower), F.lit(0.0)).alias("min_band"),
    )
    return limits.withColumns(
        {
            "axis_low": F.greatest(F.lit(0).cast("bigint"), F.floor(F.col("min_band") * 0.9)),
            "axis_high": F.ceil(F.col("max_band") * 1.1),
        }
    )


def forecast_totals(points: DataFrame) -> DataFrame:
    """One row: volume, periods and SKUs of a forecast, with labels."""
    # Two light groupings instead of two distinct counts, which would expand every row.
    by_sku = points.groupBy("sku").agg(
        F.sum("mean").alias("total"), F.min("date").alias("first"), F.max("date").alias("last")
    )
    periods = points.groupBy("date").agg(F.count("*").alias("n")).agg(F.count("*")).scalar()
    totals = by_sku.agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("volume"), F.count("*").alias("skus"))


    def counted(column: str, word: str) -> Column:
        return F.concat(F.col(column).cast("string"), F.lit(f" {word}"), F.when(F.col(column) == 1, "").otherwise("s"))

    return totals.withColumn("periods", periods).select(
        "volume", "periods", "skus",
        F.when(F.col("volume") > 0, F.concat(grouped_whole(F.col("volume")), F.lit(" units")))
        .otherwise(F.lit(NONE))
        .alias("volume_label"),
        F.when(F.col("periods") > 0, F.concat(counted("periods", "period"), F.lit(" · "), counted("skus", "SKU"))).alias(
            "horizon_label"
        ),
    )


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def best_scores(fits: DataFrame, models: dict[str, str] = MODELS) -> DataFrame:
    """(sku, model, mape, mae): least finite MAPE and its MAE, beside the chosen model."""
    ranked = [
        F.when(
            _finite(F.col(f"{prefix}_mape")),
            F.struct(
                F.col(f"{prefix}_mape").alias("mape"), F.lit(i).alias("rank"), F.col(f"{prefix}_mae").alias("mae")
            ),
        )
        for i, prefix in enumerate(models.values())
    ]
    best = fits.withColumn("best", F.array_min(F.array(*ranked)))
    return best.select("sku", "model", F.col("best.mape").alias("mape"), F.col("best.mae").alias("mae"))


def model_counts(models: DataFrame) -> DataFrame:
    return models.groupBy("model").agg(F.count("*").alias("skus"))


def _first_kpi(part: str) -> Column:
    hit = F.contains(F.lower("name"), F.lit(part))
    return F.min_by(F.when(hit, F.struct("name", "value", "unit")), F.when(hit, F.col("position")))


def kpi_lookup(kpis: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Volume and service level of each plan, with their labels."""
    found = kpis.groupBy(*by).agg(_first_kpi("total").alias("volume"), _first_kpi("service level").alias("level"))
    level, unit = F.col("level.value"), F.trim(F.coalesce("level.unit", F.lit("")))
    return found.select(
        *by,
        F.col("volume.value").alias("volume"),
        F.concat(
            grouped_whole(F.col("volume.value")), F.lit(" "),
            F.coalesce(F.nullif(F.trim("volume.unit"), F.lit("")), F.lit("units")),
        ).alias("volume_label"),
        level.alias("service_level"),
        F.when(unit != "", F.concat(F.format_string("%.2f", level), F.lit(" "), unit))
        .when(level <= 1.5, F.concat(F.format_string("%.1f", level * 100), F.lit("%")))
        .when(level.isNotNull(), F.format_string("%.1f", level))
        .otherwise(F.lit(NONE))
        .alias("service_label"),
    )


def latest(table: DataFrame, id_column: str, wanted: str | None = None, order: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """The row with the wanted id, or the newest row if there is none."""
    row = F.struct(*table.columns)
    hit = F.lit(False) if wanted is None else F.col(id_column) == wanted
    newest = table.agg(F.max_by(row, F.struct(hit, *order, id_column)).alias("row"))
    return newest.where(F.col("row").isNotNull()).select("row.*")


def plan_kpi_text(kpis: DataFrame, by: tuple[str, ...] = ("plan_id",), limit: int = KPIS_SHOWN) -> DataFrame:
    """(plan, text): the first KPIs of each plan in one line."""
    line = F.concat(
        F.col("name"), F.lit(": "), fixed(F.col("value"), 2), F.lit(" "), F.coalesce("unit", F.lit(""))
    )
    # KPIs are told apart by position, of which a plan has few; only the first ones are kept.
    kept = kpis.where(F.col("position") < limit).groupBy(*by)
    listed = kept.agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("k"))
    return listed.select(
        *by, F.concat(F.lit("Key KPIs: "), F.array_join(F.col("k.line"), "; "), F.lit(".")).alias("text")
    )


def scenario_overview(scenarios: DataFrame, order: str = "seq", limit: int = SCENARIOS_SHOWN) -> DataFrame:
    """One row: number of scenarios and the first few."""
    label = F.concat(
        F.coalesce(F.nullif("name", F.lit("")), F.lit("Scenario")), F.lit(" ("),
        F.substring("scenario_id", 1, 8), F.lit("...) for forecast "), F.col("forecast_id"),
    )
    few = scenarios.select(F.col(order).alias("o"), "scenario_id", label.alias("label")).orderBy("o", "scenario_id").limit(limit)
    examples = few.agg(F.array_join(F.array_sort(F.collect_list(F.struct("o", "scenario_id", "label")))["label"], "; ")).scalar()
    counted = scenarios.agg(F.count("*").alias("n"))
    return counted.select(
        F.col("n").alias("scenarios"),
        F.when(F.col("n") == 0, F.lit("No scenarios have been created yet."))
        .otherwise(
            F.concat(
                F.format_string("There are %d scenarios in the current session. Examples: ", "n"), examples, F.lit(".")
            )
        )
        .alias("text"),
    )


def scenario_text(scenario: DataFrame) -> DataFrame:
    """Text of chosen scenarios: the narrative, or else the KPI."""
    name = F.coalesce(F.nullif("name", F.lit("")), F.lit("Scenario"))
    head = F.concat(
        F.lit("Selected scenario "), name, F.lit(" ("), F.col("scenario_id"), F.lit(") for forecast "),
        F.col("forecast_id"), F.lit("."),
    )
    kpi = F.concat(
        F.lit("Primary KPI "), F.col("kpi"), F.lit(": base="), fixed(F.col("base"), 1), F.lit(", scenario="),
        fixed(F.col("scenario"), 1), F.lit(", delta="), fixed(F.col("delta"), 1), F.lit("."),
    )
    return scenario.select(
        "scenario_id", F.concat_ws(" ", head, F.coalesce(F.nullif("narrative", F.lit("")), kpi)).alias("text")
    )


def forecast_text(header: DataFrame, points: DataFrame, models: DataFrame, limit: int = TOP) -> DataFrame:
    """One row `text`: model, largest SKUs and model choice of a forecast.

    `header` is (forecast_id, model_name, model_version); `models` is (sku, model, seq).
    """
    top = top_skus(points, limit).select("rank", F.concat("sku", F.lit(" (~"), fixed(F.col("total"), 1), F.lit(" units)")).alias("line"))
    tops = top.agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", "line")))["line"], ", ")).scalar()
    counts = models.groupBy("model").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    chosen = counts.select("seq", F.format_string("%s: %d SKUs", "model", "n").alias("line"))
    models_line = chosen.agg(F.array_join(F.array_sort(F.collect_list(F.struct("seq", "line")))["line"], ", ")).scalar()
    return header.select(
        F.concat_ws(
            " ",
            F.format_string("Forecast %s uses model %s v%s.", "forecast_id", "model_name", "model_version"),
            F.when(tops != "", F.concat(F.lit("Top SKUs by volume: "), tops, F.lit("."))),
            F.when(models_line != "", F.concat(F.lit("Per-SKU model selection: "), models_line, F.lit("."))),
        ).alias("text")
    )


def session_counts(**tables: DataFrame) -> DataFrame:
    """(item, items): rows per table."""
    counts = [df.agg(F.lit(name).alias("item"), F.count("*").alias("items")) for name, df in tables.items()]
    return reduce(DataFrame.unionAll, counts)
