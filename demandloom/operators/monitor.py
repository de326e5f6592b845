"""Naive error monitor and the training record built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.operators.history import demand_by_key


def daily_totals(sales: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """(date, total) over all SKUs; repeated signal keys count as in `daily_demand`."""
    return (
        demand_by_key(sales.where(F.col("date").isNotNull()), signals, [])
        .groupBy("date")
        .agg(F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("total"))
    )


def demand_state(sales: DataFrame, source: Column) -> DataFrame:
    """(source, date, location, quantity, n): what training needs to know of the sales of each source.

    States of different sources are put together by a union. Locations stay apart, as repeated signals
    multiply the sales of their date and location, and signals may change after the sales were read.
    """
    dated = sales.where(F.col("date").isNotNull())
    return dated.groupBy(source.alias("source"), "date", "location").agg(F.sum("quantity").alias("quantity"), F.count("*").alias("n"))


def newest_sources(states: DataFrame, order: str = "read_at") -> DataFrame:
    """The rows of each source's last reading: a corrected source replaces what it said before."""
    last = states.groupBy("source").agg(F.max(order).alias("_last"))
    return states.join(last, "source").where(F.col(order) == F.col("_last")).drop("_last")


def totals_of_state(state: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """`daily_totals` of all sales behind a state."""
    return daily_totals(state.select("date", "location", "quantity"), signals)


def _naive(totals: DataFrame) -> DataFrame:
    # Both passes shuffle the same (date, total) rows, so Spark reuses the exchange.
    baseline = totals.agg(F.avg("total")).scalar()
    error = F.abs(F.col("total") - baseline) / F.greatest(F.col("total"), F.lit(1.0))
    return totals.agg(F.avg("total").alias("baseline"), F.avg(error).alias("mape"))


def naive_mape(sales: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """One row (baseline, mape): error of the mean daily total, days below 1 counted as 1."""
    return _naive(daily_totals(sales, signals))


def naive_mape_of_state(state: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """The same of a state, without the sales."""
    return _naive(totals_of_state(state, signals))


def training_record(errors: DataFrame) -> DataFrame:
    """Record for `ResultStore.log_run` of a row (baseline, mape)."""
    return errors.select(
        F.lit("naive_mean").alias("model_type"),
        F.lit("mape").alias("metric"),
        F.col("mape").alias("value"),
        F.concat(F.lit("baseline_mean="), F.col("baseline").cast("string")).alias("artifact"),
    )


def train_naive_mean(sales: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """Training record of the sales."""
    return training_record(naive_mape(sales, signals))
