"""Requests with the original service's fields, defaults and checks."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from demandloom.functions.dates import GRANULARITIES
from demandloom.operators.scenario import SHOCK_TYPES
from demandloom.operators.supply import DEFAULTS

OBJECTIVES = ("service_level", "margin", "cost")


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {allowed}, not {value!r}")


def split_skus(text: str) -> list[str]:
    """SKUs of a comma-separated form field."""
    return [part.strip() for part in text.split(",") if part.strip()]


@dataclass
class ForecastRequest:
    """`skus` is a list, a (sku, seq) DataFrame for long requests, or None for every SKU."""

    start_date: date
    end_date: date
    skus: list[str] | DataFrame | None = None
    granularity: str = "D"
    location: str | None = None
    forced_model: str | None = None
    external_signals: dict | None = None  # accepted, without effect
    #: History by week or month where the forecast is; else a step of any length continues daily history.
    resample: bool = False
    #: Boosted trees grown over all SKUs together instead of each SKU's own.
    pooled_trees: bool = False

    def __post_init__(self):
        _one_of("granularity", self.granularity, GRANULARITIES)
        self.location = self.location or None


@dataclass
class PlanRequest:
    forecast_id: str
    target_service_level: float = DEFAULTS["target_service_level"]
    lead_time_days: int = DEFAULTS["lead_time_days"]
    location: str | None = None
    objective: str = "service_level"  # this and the days of cover: accepted, without effect
    max_days_of_cover: int = DEFAULTS["max_days_of_cover"]
    min_days_of_cover: int = DEFAULTS["min_days_of_cover"]

    def __post_init__(self):
        _one_of("objective", self.objective, OBJECTIVES)
        self.location = self.location or None


@dataclass
class Shock:
    """Only the factor of demand shocks has an effect."""

    type: str
    start_date: date
    end_date: date
    factor: float = 1.0
    delta: float = 0.0
    sku: str | None = None
    location: str | None = None

    def __post_init__(self):
        _one_of("shock type", self.type, SHOCK_TYPES)


@dataclass
class ScenarioRequest:
    forecast_id: str
    plan_id: str | None = None
    name: str | None = None
    shocks: list[Shock] = field(default_factory=list)


SHOCK_SCHEMA = (
    "scenario_id string, type string, sku string, location string, "
    "start_date date, end_date date, factor double, delta double"
)


def shock_table(spark: SparkSession, scenario_id: str, shocks: list[Shock]) -> DataFrame:
    rows = [(scenario_id, s.type, s.sku, s.location, s.start_date, s.end_date, float(s.factor), float(s.delta)) for s in shocks]
    return spark.createDataFrame(rows, SHOCK_SCHEMA)
