"""Number formatting with round-half-even, as the report texts use it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int, sign: bool = False) -> Column:
    """`value` with a fixed number of decimals; ties go to the even digit.

    Ties are judged on the shortest decimal form of the double. Missing reads `nan`.
    """
    pattern = f"%{'+' if sign else ''}.{digits}f"
    rounded = F.bround(value, digits)
    lost_sign = value.cast("string").startswith("-") & (rounded == 0)
    plain = F.format_string(f"%.{digits}f", F.lit(0.0))
    plus = F.lit("+" if sign else "")
    infinite = F.lit(float("inf"))
    return (
        F.when(value.isNull() | F.isnan(value), F.concat(plus, F.lit("nan")))
        .when(value == infinite, F.concat(plus, F.lit("inf")))
        .when(value == -infinite, F.lit("-inf"))
        .when(lost_sign, F.concat(F.lit("-"), plain))
        .otherwise(F.format_string(pattern, rounded))
    )


def grouped_whole(value: Column) -> Column:
    """Whole number with thousands separators; halves go away from zero."""
    return F.format_number(F.round(value, 0), 0)
