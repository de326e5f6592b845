"""What-if scenarios against a base plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.functions.text import fixed

# Kinds of shock; only demand shocks change the result.
SHOCK_TYPES = ("demand", "supply", "capacity", "price")


def plan_volumes(orders: DataFrame, production: DataFrame) -> DataFrame:
    """(plan_id, volume): ordered plus produced quantity."""
    lines = orders.select("plan_id", "quantity").unionAll(production.select("plan_id", "quantity"))
    return lines.groupBy("plan_id").agg(F.sum("quantity").alias("volume"))


def base_plans(scenarios: DataFrame, plans: DataFrame) -> DataFrame:
    """Scenarios with `base_plan_id` and `status` (ok, plan_not_found, no_base_plan).

    A scenario's own plan id must exist; without one, the forecast's first plan is taken.
    `plans` is (plan_id, forecast_id, seq) with unique plan ids.
    """
    firsts = plans.groupBy("forecast_id").agg(F.min_by("plan_id", F.struct("seq", "plan_id")).alias("base_plan_id"))
    # Both lookups share one join, whose key is never missing: a NULL plan id as a join key
    # would send all such scenarios to one task.
    lookup = plans.select(F.lit("plan").alias("by"), F.col("plan_id").alias("key"), F.col("plan_id").alias("base_plan_id")).unionAll(
        firsts.select(F.lit("forecast").alias("by"), F.col("forecast_id").alias("key"), "base_plan_id")
    )
    asked = F.nullif("plan_id", F.lit(""))
    keyed = scenarios.withColumns(
        {
            "by": F.when(asked.isNotNull(), F.lit("plan")).otherwise(F.lit("forecast")),
            "key": F.coalesce(asked, "forecast_id"),
        }
    )
    found = keyed.join(lookup, ["by", "key"], "left")
    status = (
        F.when(F.col("base_plan_id").isNotNull(), "ok")
        .when(F.col("by") == "plan", "plan_not_found")
        .otherwise("no_base_plan")
    )
    return found.withColumn("status", status).drop("by", "key")


def demand_factors(shocks: DataFrame) -> DataFrame:
    """(scenario_id, factor): mean factor of the demand shocks."""
    return shocks.where(F.col("type") == "demand").groupBy("scenario_id").agg(F.avg("factor").alias("factor"))


def scenario_kpis(based: DataFrame, volumes: DataFrame, shocks: DataFrame) -> DataFrame:
    """One row per scenario with a base plan: its KPI and the demand factor."""
    base = F.coalesce("volume", F.lit(0.0))
    factor = F.coalesce("factor", F.lit(1.0))
    return (
        based.where(F.col("status") == "ok")
        .join(volumes.withColumnRenamed("plan_id", "base_plan_id"), "base_plan_id", "left")
        .join(demand_factors(shocks), "scenario_id", "left")
        .withColumns({"base": base, "factor": factor})
        .drop("volume")
        .withColumns(
            {
                "kpi": F.lit("Total Volume"),
                "scenario": F.col("base") * F.col("factor"),
                "delta": F.col("base") * F.col("factor") - F.col("base"),
                "unit": F.lit("units"),
            }
        )
    )


def narratives(kpis: DataFrame) -> DataFrame:
    """Adds a one-line `narrative`."""
    percent = F.coalesce(F.try_divide(F.col("delta"), F.col("base")) * 100.0, F.lit(0.0))
    direction = F.when(F.col("delta") > 0, "increase").when(F.col("delta") < 0, "decrease").otherwise("no change")
    volume = F.concat(
        F.lit("Total volume "), direction, F.lit(" from "), fixed(F.col("base"), 0), F.lit(" to "),
        fixed(F.col("scenario"), 0), F.lit(" units ("), fixed(percent, 1, sign=True), F.lit("%)."),
    )
    factor = F.when(
        F.col("factor") != 1.0,
        F.concat(F.lit("Average demand factor applied across shocks: x"), fixed(F.col("factor"), 2), F.lit(".")),
    )
    name = F.coalesce(F.nullif("name", F.lit("")), F.lit("Scenario"))
    return kpis.withColumn("narrative", F.concat(name, F.lit(": "), F.concat_ws(" ", volume, factor)))


def list_scenarios(
    scenarios: DataFrame, forecast_id: str | None = None, plan_id: str | None = None
) -> DataFrame:
    """(scenario_id, forecast_id, plan_id, name), filtered by the ids that are given."""
    for column, wanted in (("forecast_id", forecast_id), ("plan_id", plan_id)):
        if wanted is not None:
            scenarios = scenarios.where(F.col(column) == wanted)
    return scenarios.select("scenario_id", "forecast_id", "plan_id", "name")


def delta_percent(kpis: DataFrame) -> DataFrame:
    """Adds `delta_percent`; NULL where the base is 0."""
    return kpis.withColumn("delta_percent", F.try_divide(F.lit(100.0) * F.col("delta"), F.col("base")))
