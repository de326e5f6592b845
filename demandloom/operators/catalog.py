"""Column checks over a catalog of many datasets: one row per (dataset, pos, column).

Column names per dataset are compared with fixed word lists inside each row, so a catalog of
any size needs one shuffle by dataset, after map-side aggregation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.names import clean_name, clean_name_col
from demandloom.schemas import KINDS, REQUIRED_COLUMNS, SALES_ROLES

# Words that tell a dataset's kind, kinds in order of preference.
KIND_WORDS = {
    "sales": [
        "quantity", "qty", "units", "order", "product", "sku", "customer", "totalprice",
        "date", "amount", "volume", "sales",
    ],
    "inventory": ["stock", "onhand", "inventory", "warehouse", "location", "sku", "reorder", "quantity"],
    "production": ["production", "line", "capacity", "machine", "shift", "schedule", "quantity"],
    "purchase_orders": ["po", "purchase", "supplier", "eta", "orderdate", "quantity", "location", "vendor"],
    "master_data": ["description", "category", "uom", "segment", "attribute", "name", "id"],
    "external_signals": ["signal", "trend", "index", "score", "weather", "holiday", "sentiment", "date"],
}
# Words that let a low score still mean sales.
QUANTITY_WORDS = ["quantity", "qty", "units", "amount", "volume"]
TIME_WORDS = ["date", "time", "period"]
TRADE_WORDS = ["sales", "order", "customer"]


def guess_columns(
    catalog: DataFrame,
    roles: dict[str, list[str]] = SALES_ROLES,
    style: str = "ingest",
    by_candidate: bool = False,
) -> DataFrame:
    """(dataset, role, column) for each role that a column fits; see `names.guess_column`."""
    keys = F.array(
        *[
            F.struct(F.lit(role).alias("role"), F.lit(i).alias("rank"), F.lit(clean_name(c, style)).alias("key"))
            for role, candidates in roles.items()
            for i, c in enumerate(candidates)
        ]
    )
    order = F.struct("pos", "column")
    spelling = F.min_by("column", order) if by_candidate else F.max_by("column", order)
    # Names that fit no role are left out before anything is shuffled: one walk through each name for all words.
    words = "|".join(sorted({re.escape(clean_name(c, style)) for candidates in roles.values() for c in candidates}))
    cleaned = catalog.withColumn("cleaned", clean_name_col(F.col("column"), style))
    fitting = cleaned.where(F.col("cleaned").rlike(words))
    names = fitting.groupBy("dataset", "cleaned").agg(F.min(order).alias("place"), spelling.alias("column"))
    hits = names.select(
        "dataset", "place", "column", "cleaned",
        F.inline(F.filter(keys, lambda k: F.contains(F.col("cleaned"), k["key"]))),
    )
    partial = F.lit(0) if by_candidate else (F.col("cleaned") != F.col("key")).cast("int")
    return hits.groupBy("dataset", "role").agg(
        F.min_by("column", F.struct(partial.alias("partial"), "rank", "place")).alias("column")
    )


def missing_columns(catalog: DataFrame) -> DataFrame:
    """(dataset, kind, missing) over a catalog with a `kind`: required names not found, sorted."""
    required = F.create_map(
        *[part for k in KINDS for part in (F.lit(k), F.array(*map(F.lit, REQUIRED_COLUMNS[k])).cast("array<string>"))]
    )
    cleaned = clean_name_col(F.col("column"), "upload")
    known = sorted({clean_name(c, "upload") for names in REQUIRED_COLUMNS.values() for c in names})
    found = catalog.groupBy("dataset", "kind").agg(
        # At most the fixed list of required names is collected, however wide a dataset is.
        F.collect_set(F.when(cleaned.isin(known), cleaned)).alias("found")
    )
    missing = F.filter(
        F.coalesce(required[F.col("kind")], F.array().cast("array<string>")),
        lambda name: ~F.array_contains(F.col("found"), clean_name_col(name, "upload")),
    )
    return found.select("dataset", "kind", F.array_join(F.array_sort(missing), ", ").alias("missing"))


def missing_warning(kind: Column, missing: Column) -> Column:
    text = F.concat(F.lit("Missing expected columns for "), kind, F.lit(": "), missing)
    return F.when(missing != "", text)


def dataset_kinds(catalog: DataFrame) -> DataFrame:
    """(dataset, kind, score): kind with the most words found in any column name.

    Each row marks its words as bits, so a dataset of any width reduces to one number.
    """
    words = sorted({w for group in (*KIND_WORDS.values(), TIME_WORDS) for w in group})
    # A step of its own, so that a name is cleaned once and not once per word.
    names = catalog.select("dataset", clean_name_col(F.col("column"), "screen").alias("cleaned"))
    bits = F.lit(0).cast("bigint")
    for i, word in enumerate(words):
        bits = bits.bitwiseOR(F.when(F.contains("cleaned", F.lit(word)), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    seen = names.select("dataset", bits.alias("bits")).groupBy("dataset").agg(F.bit_or("bits").alias("seen"))

    def mask(group: list[str]) -> Column:
        return F.col("seen").bitwiseAND(F.lit(sum(1 << words.index(w) for w in group)).cast("bigint"))

    # Score and preference in one number, so that the best kind is a plain maximum.
    kinds = list(KIND_WORDS)
    ranked = [F.bit_count(mask(KIND_WORDS[kind])) * len(kinds) + (len(kinds) - 1 - i) for i, kind in enumerate(kinds)]
    best = seen.withColumn("best", F.greatest(*ranked)).select(
        "dataset",
        "seen",
        F.floor(F.col("best") / len(kinds)).cast("int").alias("score"),
        F.get(F.array(*map(F.lit, kinds)), len(kinds) - 1 - F.col("best") % len(kinds)).alias("kind"),
    )
    low_sales = (
        (F.col("score") == 1)
        & (F.col("kind") == "sales")
        & (mask(QUANTITY_WORDS) != 0)
        & ((mask(TIME_WORDS) != 0) | (mask(TRADE_WORDS) != 0))
    )
    kind = F.when((F.col("score") >= 2) | low_sales, F.col("kind"))
    return best.select("dataset", kind.alias("kind"), "score")
