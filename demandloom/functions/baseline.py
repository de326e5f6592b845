"""Closed-form baseline forecast and its uncertainty band."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the baseline shape and band.
WAVE_SPAN = 2.5 * math.pi
WAVE_SIZE = 0.12
TREND_LOW, TREND_HIGH = -0.08, 0.08
RIPPLE_SIZE, RIPPLE_RATE = 0.05, 1.7
BAND_LOW, BAND_HIGH = 0.8, 1.2
DEFAULT_BASE = 100.0


def baseline_value(base: Column, step: Column, steps: Column) -> Column:
    """Baseline at 0-based `step` of `steps`: trend plus a wave and a ripple, never below 0."""
    phase = F.lit(WAVE_SPAN) * step / steps
    slope = F.lit(TREND_HIGH - TREND_LOW) * step / F.greatest(steps - 1, F.lit(1))
    level = base * (F.lit(1.0) + F.lit(WAVE_SIZE) * F.sin(phase) + (F.lit(TREND_LOW) + slope))
    ripple = F.lit(RIPPLE_SIZE) * base * F.sin(phase * RIPPLE_RATE)
    return F.greatest(level + ripple, F.lit(0.0))


def band(mean: Column) -> list[Column]:
    return [
        (mean * BAND_LOW).alias("q10"),
        mean.alias("q50"),
        (mean * BAND_HIGH).alias("q90"),
    ]
