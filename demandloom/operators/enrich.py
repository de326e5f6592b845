"""Sales joined with external signals, and missing signals filled."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.schemas import HOLIDAY, MEAN_SIGNALS
from demandloom.sources.files import quoted

KEYS = ["date", "location"]
SIZE = re.compile(r"^(-?\d+)\s*([a-zA-Z]*)$")
UNITS = {"": 1, "b": 1, **{u + tail: 1 << 10 * i for i, u in enumerate("kmgt", 1) for tail in ("", "b")}}


def _part_names(sales: DataFrame, signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns both sides share, keys aside, get the suffixes `_x` and `_y`."""
    shared = (set(sales.columns) & set(signals.columns)) - set(KEYS)
    if shared & {"sku", "quantity"}:
        raise ValueError("signals must not have a sku or quantity column")
    return (
        sales.withColumnsRenamed({c: f"{c}_x" for c in shared}),
        signals.withColumnsRenamed({c: f"{c}_y" for c in shared}),
    )


def repeated_signal_keys(signals: DataFrame) -> DataFrame:
    """Keys that occur more than once; each would multiply the sales it meets."""
    return signals.groupBy(*KEYS).agg(F.count("*").alias("copies")).where("copies > 1")


def join_by_key(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on date and location, where missing keys meet each other.

    There is no broadcast hint: Spark broadcasts the right side only when its size is known
    to be small, and AQE splits a hot (date, location) of the sort-merge join.
    """
    right = right.select(
        quoted("date").cast("date").alias("_date"), quoted("location").alias("_location"),
        *[quoted(c) for c in right.columns if c not in KEYS],
    )
    match = F.col("date").eqNullSafe(F.col("_date")) & F.col("location").eqNullSafe(F.col("_location"))
    return left.join(right, match, "left").drop("_date", "_location")


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """The table with a broadcast hint if its measured size is within the session's threshold.

    Texts and nested values are measured, fixed ones counted as 16 bytes. The measure is a job of its
    own. It spares the far larger side a shuffle that Spark would have begun before it knows
    the size of an aggregated table.
    """
    setting = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    least = int(SIZE.match(setting)[1]) * UNITS[SIZE.match(setting)[2].lower()]
    if least <= 0:
        return df
    width = F.lit(16).cast("bigint")
    for name, kind in df.dtypes:
        width = width + 16
        if kind == "string":
            width = width + F.coalesce(F.octet_length(quoted(name)), F.lit(0))
        elif kind.startswith(("array", "map", "struct", "binary", "variant")):
            # Text of a nested value; four times that is more than its binary form takes.
            width = width + 4 * F.coalesce(F.octet_length(quoted(name).cast("string")), F.lit(0))
    size = df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= least else df


def attach_signals(sales: DataFrame, signals: DataFrame) -> DataFrame:
    """All sales with the signals of their date and location."""
    left, right = _part_names(sales, signals)
    return join_by_key(left, broadcast_if_small(right))


def signal_means(sales: DataFrame, signals: DataFrame) -> DataFrame:
    """One row: each signal's mean over the joined sales rows.

    Sales shrink to a count per (date, location) before they meet the signals, so no task
    ever sees the rows of a hot key.
    """
    left, right = _part_names(sales, signals)
    present = [c for c in MEAN_SIGNALS if c in right.columns and c not in left.columns]
    # Sales-side columns of these names are filled with their own mean.
    own = [c for c in MEAN_SIGNALS if c in left.columns]
    counts = left.groupBy(*KEYS).agg(
        F.count("*").alias("sales_rows"),
        *[F.sum(quoted(c)).alias(f"s_{c}") for c in own],
        *[F.count(quoted(c)).alias(f"n_{c}") for c in own],
    )
    joined = join_by_key(counts, right.select(*KEYS, *present))
    weight = F.col("sales_rows")
    return joined.agg(
        F.struct(
            F.count("*").alias("keys"),
            *[
                F.try_divide(F.sum(quoted(c) * weight), F.sum(F.when(quoted(c).isNotNull(), weight))).alias(c)
                for c in present
            ],
            *[F.try_divide(F.sum(f"s_{c}"), F.sum(f"n_{c}")).alias(c) for c in own],
        ).alias("means")
    )


def fill_signals(merged: DataFrame, means: Column) -> DataFrame:
    """Missing holidays become 0 and other missing signals their mean."""
    fills = {c: F.coalesce(quoted(c), means[c]) for c in MEAN_SIGNALS if c in merged.columns}
    if HOLIDAY in merged.columns:
        fills[HOLIDAY] = F.coalesce(quoted(HOLIDAY), F.lit(0))
    return merged.withColumns(fills)


def sales_with_signals(sales: DataFrame, signals: DataFrame) -> DataFrame:
    """The feature table: every sales row with filled signals."""
    merged = attach_signals(sales, signals).withColumn("_means", signal_means(sales, signals).scalar())
    return fill_signals(merged, F.col("_means")).drop("_means")
