"""Safety stock, purchase and production plan, and plan KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the plan.
HIGH_SERVICE, HIGH_Z, LOW_Z = 0.95, 1.65, 1.0
PURCHASE_SHARE, PRODUCTION_SHARE = 0.4, 0.6
LINE, ORDER_TYPE = "LINE-1", "purchase"
DEFAULTS = {"target_service_level": 0.95, "max_days_of_cover": 90, "min_days_of_cover": 0, "lead_time_days": 10}


def point_span(points: DataFrame) -> Column:
    """Struct (first, last) date over all SKUs, as a scalar subquery that reads dates only."""
    return points.agg(F.struct(F.min("date").alias("first"), F.max("date").alias("last"))).scalar()


def demand_summary(points: DataFrame, span: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(sku, demand, first_date, horizon_days); the dates are those of the whole forecast.

    A caller that knows the forecast's horizon passes it as `span` and saves a scan.
    """
    if span is None:
        span = point_span(points)
    return points.groupBy(*by, "sku").agg(F.sum("mean").alias("demand")).select(
        *by, "sku", "demand",
        span["first"].alias("first_date"),
        (F.date_diff(span["last"], span["first"]) + 1).alias("horizon_days"),
    )


def safety_stock(demand: Column, horizon_days: Column, lead_time_days: Column, service_level: Column) -> Column:
    z = F.when(service_level >= HIGH_SERVICE, F.lit(HIGH_Z)).otherwise(F.lit(LOW_Z))
    stock = F.try_divide(demand, horizon_days) * lead_time_days.cast("double") * z
    return F.when(horizon_days > 0, stock).otherwise(F.lit(0.0))


def requirements(
    demand: DataFrame,
    target_service_level: float = DEFAULTS["target_service_level"],
    lead_time_days: int = DEFAULTS["lead_time_days"],
    constraints: DataFrame | None = None,
) -> DataFrame:
    """Adds safety stock, required quantity and its purchase and production parts.

    `constraints` (sku, target_service_level, lead_time_days) override the two values per SKU.
    """
    level, lead = F.lit(target_service_level), F.lit(lead_time_days)
    if constraints is not None:
        demand = demand.join(constraints, "sku", "left")
        level = F.coalesce("target_service_level", level)
        lead = F.coalesce("lead_time_days", lead)
    stock = safety_stock(F.col("demand"), F.col("horizon_days"), lead, level)
    return (
        demand.withColumn("safety_stock", stock)
        .withColumn("required", F.col("demand") + F.col("safety_stock"))
        .withColumns(
            {
                "purchase": F.col("required") * PURCHASE_SHARE,
                "production": F.col("required") * PRODUCTION_SHARE,
            }
        )
        .drop("target_service_level", "lead_time_days")
    )


def orders(required: DataFrame, location: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    return required.where(F.col("purchase") > 0).select(
        *by, "sku", F.lit(location).cast("string").alias("location"), F.col("first_date").alias("order_date"),
        F.col("purchase").alias("quantity"), F.lit(ORDER_TYPE).alias("order_type"),
    )


def production(required: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return required.where(F.col("production") > 0).select(
        *by, "sku", F.lit(LINE).alias("line_id"), F.col("first_date").alias("production_date"),
        F.col("production").alias("quantity"),
    )


def plan_kpis(
    required: DataFrame, target_service_level: float = DEFAULTS["target_service_level"], by: tuple[str, ...] = ()
) -> DataFrame:
    """(position, name, value, unit); no rows for an empty plan."""
    total = required.groupBy(*by).agg(F.sum("required").alias("total"), F.count("*").alias("lines")).where("lines > 0")
    rows = F.array(
        F.struct(
            F.lit(0).alias("position"), F.lit("Total Volume").alias("name"),
            F.col("total").alias("value"), F.lit("units").alias("unit"),
        ),
        F.struct(
            F.lit(1).alias("position"), F.lit("Target Service Level").alias("name"),
            F.lit(float(target_service_level)).alias("value"), F.lit("").alias("unit"),
        ),
    )
    return total.select(*by, F.inline(rows))
