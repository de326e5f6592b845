"""Forecast errors over arrays of actual and predicted values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _mean_or_inf(errors: Column) -> Column:
    total = F.aggregate(errors, F.lit(0.0), lambda acc, e: acc + e)
    return F.coalesce(F.try_divide(total, F.size(errors)), F.lit(float("inf")))


def mape(actual: Column, predicted: Column) -> Column:
    """Mean absolute error as a fraction of actuals above 0; infinite if there are none."""
    errors = F.zip_with(actual, predicted, lambda y, p: F.when(y > 0, F.abs((y - p) / y)))
    return F.when(predicted.isNotNull(), _mean_or_inf(F.filter(errors, lambda e: e.isNotNull())))


def mae(actual: Column, predicted: Column) -> Column:
    """Mean absolute error; infinite for an empty series."""
    errors = F.zip_with(actual, predicted, lambda y, p: F.abs(y - p))
    return F.when(predicted.isNotNull(), _mean_or_inf(errors))
