"""Sales tables with any column names, mapped to date, sku, location and quantity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.dates import DATE_FORMATS, parse_date
from demandloom.functions.names import guess_column
from demandloom.schemas import NO_LOCATION, NO_SKU, SALES_ROLES
from demandloom.sources.files import quoted
from demandloom.sources.watch import UnreadableValues, Watch


class UnreadableSales(UnreadableValues):
    """Sales with dates or quantities that cannot be read."""


def sales_columns(names: list[str]) -> dict[str, str]:
    """Role of each chosen column, `{column: role}`.

    A column chosen twice serves one role: date before all others, else the later role.
    """
    picked = {role: guess_column(names, candidates) for role, candidates in SALES_ROLES.items()}
    if picked["date"] is None or picked["quantity"] is None:
        raise ValueError(f"no usable date or quantity column among {names}")
    roles = {name: role for role, name in picked.items() if name is not None}
    roles[picked["date"]] = "date"
    if "quantity" not in roles.values():
        raise ValueError(f"the date column {picked['date']!r} is the only quantity column among {names}")
    return roles


def _as_date(column: Column, dtype: str, formats: tuple[str, ...]) -> Column:
    return parse_date(column, formats) if dtype == "string" else column.cast("date")


def _as_number(column: Column) -> Column:
    return F.nanvl(column.try_cast("double"), F.lit(None).cast("double"))


def harmonize_sales(raw: DataFrame, formats: tuple[str, ...] = DATE_FORMATS, watch: Watch | None = None) -> DataFrame:
    """Sales roles first, all other columns after them under their own names.

    Dates lose their time of day. Dates and quantities that cannot be read become NULL; a `watch`
    counts them in the same scan, `unreadable_sales` in one of its own.
    """
    roles = sales_columns(raw.columns)
    dtypes = dict(raw.dtypes)
    by_role = {role: name for name, role in roles.items()}
    rest = [c for c in raw.columns if c not in roles]
    clash = {c for c in rest if c.lower() in SALES_ROLES}
    if clash:
        raise ValueError(f"columns {sorted(clash)} would repeat a sales role")
    sku, location = by_role.get("sku"), by_role.get("location")
    date, quantity = quoted(by_role["date"]), quoted(by_role["quantity"])
    roles_first = [
        _as_date(date, dtypes[by_role["date"]], formats).alias("date"),
        (quoted(sku).cast("string") if sku else F.lit(NO_SKU)).alias("sku"),
        (quoted(location).cast("string") if location else F.lit(NO_LOCATION)).alias("location"),
        _as_number(quantity).alias("quantity"),
    ]
    if watch is None:
        return raw.select(*roles_first, *[quoted(c) for c in rest])
    both = raw.select(*roles_first, *[quoted(c) for c in rest], date.alias("_date"), quantity.alias("_quantity"))
    bad = {
        "date": (F.col("_date").isNotNull() & F.col("date").isNull(), F.col("_date")),
        # Not a number is a value, though one that counts as missing.
        "quantity": (F.col("_quantity").isNotNull() & F.col("_quantity").try_cast("double").isNull(), F.col("_quantity")),
    }
    return watch.over(both, bad).drop("_date", "_quantity")


def unreadable_sales(raw: DataFrame, formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """One row: rows, and how many dates and quantities are present but cannot be read."""
    by_role = {role: name for name, role in sales_columns(raw.columns).items()}
    date, quantity = quoted(by_role["date"]), quoted(by_role["quantity"])
    parsed = _as_date(date, dict(raw.dtypes)[by_role["date"]], formats)
    return raw.agg(
        F.count("*").alias("rows"),
        F.count_if(date.isNotNull() & parsed.isNull()).alias("bad_dates"),
        F.count_if(quantity.isNotNull() & quantity.try_cast("double").isNull()).alias("bad_quantities"),
    )
