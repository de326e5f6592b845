"""Demand drivers and the summary of recent signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandloom.functions.text import fixed

# Drivers with importance and direction.
DRIVERS = [
    ("trend", 0.3, "positive"),
    ("seasonality", 0.25, "positive"),
    ("promotion", 0.2, "positive"),
    ("holiday", 0.1, "positive"),
    ("price", 0.1, "negative"),
    ("weather", 0.05, "negative"),
]
RANK_STEP = 0.05
METHOD = "stub-shap-like"


def _drivers() -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("position"), F.lit(f).alias("feature"),
                F.lit(w).alias("importance"), F.lit(d).alias("direction"),
            )
            for i, (f, w, d) in enumerate(DRIVERS)
        ]
    )


def global_drivers(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.inline(_drivers()))


def ranked_skus(points: DataFrame, per_range: int = 50_000) -> DataFrame:
    """(sku, rank): 0-based place of each distinct SKU in sort order.

    A global window would sort all SKUs in one task. Instead about one SKU in `per_range`, picked by
    hash so that every run picks the same, cuts the sort order into ranges, whose number thus follows
    the number of SKUs. Each range is ranked on its own and shifted by the sizes of those before it.
    """
    skus = points.select("sku").distinct()
    few = skus.where(F.pmod(F.xxhash64("sku"), F.lit(per_range)) == 0)
    splitters = few.agg(F.array_sort(F.collect_list("sku"))).scalar()
    # Binary search: how many splitters stand at or before the SKU. 2^20 splitters are enough.
    steps = F.lit([1 << i for i in reversed(range(20))])

    def step(low: Column, by: Column) -> Column:
        return F.when(F.get("splitters", low + by - 1) <= F.col("sku"), low + by).otherwise(low)

    ranged = skus.withColumn("splitters", splitters).select("sku", F.aggregate(steps, F.lit(0), step).alias("range"))
    # One entry per range; their running sums are added up once.
    counts = ranged.groupBy("range").agg(F.count("*").alias("size"))
    sizes = counts.agg(F.array_sort(F.collect_list(F.struct("range", "size"))).alias("sizes"))
    running = F.aggregate(
        "sizes",
        F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<struct<at:int,before:bigint>>").alias("rows")),
        lambda acc, r: F.struct(
            (acc["total"] + r["size"]).alias("total"),
            F.concat(acc["rows"], F.array(F.struct(r["range"].alias("at"), acc["total"].alias("before")))).alias("rows"),
        ),
    )
    before = sizes.select(F.inline(running["rows"]))
    placed = ranged.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy("sku")))
    return placed.join(before, F.col("range") == F.col("at")).select("sku", (F.col("before") + F.col("place") - 1).alias("rank"))


def drivers_by_sku(points: DataFrame) -> DataFrame:
    """(sku, position, feature, importance, direction); importance grows with the SKU's rank."""
    scale = F.lit(1.0) + F.lit(RANK_STEP) * F.col("rank")
    return ranked_skus(points).select("sku", scale.alias("scale"), F.inline(_drivers())).select(
        "sku", "position", "feature", (F.col("importance") * F.col("scale")).alias("importance"), "direction"
    )


def importance_percent(drivers: DataFrame) -> DataFrame:
    return drivers.withColumn("importance_percent", F.col("importance") * 100)


def recent_signals(signals: DataFrame, days: int = 14, location: str | None = None) -> DataFrame:
    """One row of facts about the signals of the last `days` days.

    Several rows of one date are ordered by location, so the first and last are certain.
    """
    rows = signals.withColumn("date", F.col("date").cast("date"))
    if location is not None and "location" in rows.columns:
        rows = rows.where(F.col("location") == location)
    newest = rows.agg(F.max("date")).scalar()
    recent = rows.where(newest.isNull() | (F.col("date") >= F.date_sub(newest, days)))
    order = F.struct(*[c for c in ("date", "location") if c in rows.columns])

    def fact(name: str, value: Column) -> Column:
        return (value if name in rows.columns else F.lit(None)).cast("double")

    trend = "google_trends_index"
    return recent.agg(
        F.count("*").alias("rows"),
        fact(trend, F.min_by(trend, order) if trend in rows.columns else F.lit(None)).alias("trend_first"),
        fact(trend, F.max_by(trend, order) if trend in rows.columns else F.lit(None)).alias("trend_last"),
        fact("temperature", F.min("temperature") if "temperature" in rows.columns else F.lit(None)).alias("temperature_min"),
        fact("temperature", F.max("temperature") if "temperature" in rows.columns else F.lit(None)).alias("temperature_max"),
        fact("is_holiday", F.sum("is_holiday") if "is_holiday" in rows.columns else F.lit(None)).alias("holidays"),
    )


def signal_summary(signals: DataFrame, days: int = 14, location: str | None = None) -> DataFrame:
    """One row `summary`: the facts in words, NULL when there is nothing to say."""
    facts = recent_signals(signals, days, location)
    change = F.when(
        F.col("trend_first") > 0,
        (F.col("trend_last") - F.col("trend_first")) / F.nullif("trend_first", F.lit(0.0)) * 100.0,
    ).otherwise(F.lit(0.0))
    parts = []
    if "google_trends_index" in signals.columns:
        parts.append(
            F.concat(
                F.lit("Google search interest moved from "), fixed(F.col("trend_first"), 0), F.lit(" to "),
                fixed(F.col("trend_last"), 0), F.lit(f" over the last {days} days ("), fixed(change, 1, sign=True),
                F.lit("% change)."),
            )
        )
    if "temperature" in signals.columns:
        parts.append(
            F.concat(
                F.lit("Observed temperature range in the same window: "), fixed(F.col("temperature_min"), 1),
                F.lit("–"), fixed(F.col("temperature_max"), 1), F.lit("°C."),
            )
        )
    if "is_holiday" in signals.columns:
        parts.append(
            F.when(F.col("holidays") > 0, F.lit("Recent days include holidays, which may drive demand peaks."))
        )
    text = F.concat_ws(" ", *parts) if parts else F.lit("")
    return facts.select(F.when(F.col("rows") > 0, F.nullif(text, F.lit(""))).alias("summary"))
