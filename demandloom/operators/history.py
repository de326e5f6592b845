"""Daily demand per SKU."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandloom.operators.enrich import join_by_key
from demandloom.session import fit_partitions


def requested_skus(spark: SparkSession, skus: list[str]) -> DataFrame:
    """(sku, seq) of a request; a SKU may come twice."""
    return spark.createDataFrame(list(zip(skus, range(len(skus)))), "sku string, seq int")


def demand_by_key(sales: DataFrame, signals: DataFrame | None, by: list[str]) -> DataFrame:
    """Quantity summed by `by` and date, and by location where it matters.

    Signals matter only through repeated (date, location) keys, which multiply the sales they
    meet. Both sides are aggregated to those keys first, so the join carries one row per key
    however many sales share it.
    """
    if signals is None:
        return sales.groupBy(*by, "date").agg(F.sum("quantity").alias("quantity"))
    keyed = sales.groupBy(*dict.fromkeys([*by, "location", "date"])).agg(F.sum("quantity").alias("quantity"))
    copies = signals.groupBy(F.col("date").cast("date").alias("date"), "location").agg(F.count("*").alias("_copies"))
    times = F.coalesce("_copies", F.lit(1))
    return join_by_key(keyed, copies).withColumn("quantity", F.col("quantity") * times).drop("_copies")


def daily_demand(
    sales: DataFrame,
    signals: DataFrame | None = None,
    requested: DataFrame | None = None,
    location: str | None = None,
) -> DataFrame:
    """(sku, date, quantity): demand summed by day, days without sales left out.

    A location that a SKU never has is ignored for that SKU.
    """
    rows = sales.where(F.col("sku").isNotNull())
    if requested is not None:
        rows = rows.join(requested.select("sku").distinct(), "sku", "left_semi")
    if location is None:
        dated = rows.where(F.col("date").isNotNull())
        total = F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("quantity")
        keyed = dated if signals is None else demand_by_key(dated, signals, ["sku"])
        return keyed.groupBy("sku", "date").agg(total)
    here = F.coalesce(F.col("location") == location, F.lit(False))
    keyed = rows if signals is None else demand_by_key(rows, signals, ["sku", "location"])
    both = keyed.groupBy("sku", "date").agg(
        F.sum("quantity").alias("everywhere"),
        F.sum(F.when(here, F.col("quantity"))).alias("here"),
        F.max(here).alias("is_here"),
    )
    # One row per day of a SKU, so the window is bounded by the calendar.
    both = both.withColumn("found", F.max("is_here").over(Window.partitionBy("sku")))
    return both.where(F.col("date").isNotNull() & (~F.col("found") | F.col("is_here"))).select(
        "sku",
        "date",
        F.coalesce(F.when(F.col("found"), F.col("here")).otherwise(F.col("everywhere")), F.lit(0.0)).alias("quantity"),
    )


def period_end(day: Column, granularity: str) -> Column:
    """Last day of the week, a Sunday, or of the month."""
    return F.next_day(F.date_sub(day, 1), "Sun") if granularity == "W" else F.last_day(day)


def period_start(end: Column, granularity: str) -> Column:
    return F.date_sub(end, 6) if granularity == "W" else F.trunc(end, "month")


def resample(daily: DataFrame, granularity: str) -> DataFrame:
    """(sku, date, quantity, partial): demand by week or month, dated by the period's last day.

    All periods from a SKU's first to its last are there, those without sales with 0. The first
    is partial if the SKU's days begin after its first day, the last if they end before its last.
    Both groupings share one exchange by SKU, and what is collected is bounded by the calendar.
    """
    if granularity not in ("W", "M"):
        raise ValueError(f"granularity must be 'W' or 'M' here, not {granularity!r}")
    dated = daily.where(F.col("date").isNotNull()).repartition("sku")
    ends = dated.withColumn("end", period_end(F.col("date"), granularity))
    periods = ends.groupBy("sku", "end").agg(F.sum("quantity").alias("quantity"), F.min("date").alias("first"), F.max("date").alias("last"))
    packed = periods.groupBy("sku").agg(
        F.map_from_entries(F.collect_list(F.struct("end", "quantity"))).alias("sums"), F.min("first").alias("first"), F.max("last").alias("last"),
    )
    first, last = (period_end(F.col(c), granularity) for c in ("first", "last"))
    if granularity == "W":
        all_ends = F.sequence(first, last, F.expr("INTERVAL 7 DAY"))
    else:
        all_ends = F.transform(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("INTERVAL 1 MONTH")), F.last_day)
    rows = packed.select("sku", "sums", "first", "last", F.explode(all_ends).alias("date"))
    begun_late = (F.col("first") > period_start(F.col("date"), granularity)) & (F.col("first") <= F.col("date"))
    ended_early = (F.col("last") < F.col("date")) & (F.col("last") >= period_start(F.col("date"), granularity))
    return rows.select("sku", "date", F.coalesce(F.col("sums")[F.col("date")], F.lit(0.0)).alias("quantity"), (begun_late | ended_early).alias("partial"))


def whole_periods(periods: DataFrame) -> DataFrame:
    """(sku, date, quantity) without partial periods, which would read as a fall in demand; a SKU that has no others keeps them."""
    any_whole = F.max(~F.col("partial")).over(Window.partitionBy("sku"))  # a SKU's rows are bounded by the calendar
    return periods.withColumn("_whole", any_whole).where("NOT partial OR NOT _whole").select("sku", "date", "quantity")


def pack_series(
    daily: DataFrame, requested: DataFrame | None = None, partitions: int | None = None
) -> DataFrame:
    """(sku, dates, quantities): one row per SKU, ascending by date.

    A series has one value per day, so its length is bounded by the calendar and not by the
    number of sales. SKUs of `requested` without demand get empty arrays.
    """
    if requested is not None:
        bare = requested.select("sku", F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("quantity"))
        daily = daily.unionByName(bare.distinct())
    point = F.when(F.col("date").isNotNull(), F.struct("date", "quantity"))
    return (
        daily.repartition(partitions or fit_partitions(daily.sparkSession), "sku")
        .groupBy("sku")
        .agg(F.sort_array(F.collect_list(point)).alias("points"))
        .select("sku", F.col("points.date").alias("dates"), F.col("points.quantity").alias("quantities"))
    )
