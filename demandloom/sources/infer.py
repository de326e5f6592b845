"""Types of text columns, inferred from all their values in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.dates import parse_date
from demandloom.functions.names import clean_name
from demandloom.schemas import SALES_ROLES
from demandloom.sources.files import quoted

#: What a text may read as, one bit each. A whole number reads as `double` too, so the bits that
#: all values of a column share are the types that hold all of them.
READS_AS = {"boolean": 1, "bigint": 2, "double": 4, "date": 8}

# Digits after a leading zero are a key such as 007 and no number.
WHOLE = r"^[+-]?(0|[1-9]\d{0,17})$"
NUMBER = r"^[+-]?((0|[1-9]\d*)(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
#: Only texts like these are tried as dates.
DATE_LIKE = r"^[\dA-Za-z][\dA-Za-z:,./\- ]{2,30}\d[AaPpMm ]{0,3}$"

#: Columns that hold keys and words stay text whatever they look like.
TEXT_NAMES = {
    clean_name(n, "upload")
    for n in (*SALES_ROLES["sku"], *SALES_ROLES["location"], "po_id", "line_id", "supplier", "description", "category", "uom")
}


def reads_as(value: Column) -> Column:
    """Bits of the types a text reads as; NULL for a missing one. Of plain numbers, only eight digits may be a date."""
    boolean, whole, double, date = READS_AS.values()
    day = lambda text: F.when(parse_date(text).isNotNull(), date).otherwise(0)

    def judged(text: Column) -> Column:
        return (
            F.when(text.rlike(WHOLE), whole + double + F.when(F.length(text) == 8, day(text)).otherwise(0))
            .when(text.rlike(NUMBER), double)
            .when(F.lower(text).isin("true", "false"), boolean)
            .when(F.lower(text).isin("nan", "inf", "-inf", "+inf", "infinity", "-infinity"), double)
            .when(text.rlike(DATE_LIKE), day(text))
            .otherwise(0)
        )

    # The trimmed text enters as one value, so that it is trimmed once and not by each test.
    return F.when(value.isNotNull(), F.transform(F.array(F.trim(value)), judged)[0])


def stays_text(name: str) -> bool:
    return clean_name(name, "upload") in TEXT_NAMES


def _chosen(name: str, bits: Column) -> Column:
    """The narrowest type that all values share; without values `double`, as there is no text."""
    order = ["boolean", "bigint", "double", "date"]
    if "date" in name.lower():  # 20240131 is a date there, and a number elsewhere
        order = ["date", *order[:-1]]
    found = F.when(bits.isNull(), "double")
    for kind in order:
        found = found.when(bits.bitwiseAND(READS_AS[kind]) > 0, kind)
    return found.otherwise("string")


def infer_types(df: DataFrame) -> DataFrame:
    """(pos, name, dtype, filled, missing) of each column.

    A text column gets the type that every value of it reads as: boolean, bigint, double, date, or else
    string. All columns are judged in one scan, as a bit mask each; nothing is sampled. Other
    columns keep their type.
    """
    names = {f"c{i}": name for i, name in enumerate(df.columns)}
    kinds = dict(zip(names, [t for _, t in df.dtypes]))
    judged = [c for c, name in names.items() if kinds[c] == "string" and not stays_text(name)]
    # One test for all columns, applied to each in turn: spelled out per column it would outgrow compiled code.
    bits = F.transform(F.array(*judged), reads_as) if judged else F.array().cast("array<int>")
    seen = df.toDF(*names).withColumn("_bits", bits)
    facts, rows = [F.count(F.lit(1)).alias("_n")], []
    for pos, (c, name) in enumerate(names.items()):
        facts.append(F.count(c).alias(f"n_{c}"))
        shown: Column = F.lit(kinds[c])
        if c in judged:
            facts.append(F.bit_and(F.col("_bits")[judged.index(c)]).alias(f"b_{c}"))
            shown = _chosen(name, F.col(f"b_{c}"))
        filled = F.col(f"n_{c}")
        rows.append(
            F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("name"), shown.alias("dtype"), filled.alias("filled"), (F.col("_n") - filled).alias("missing"))
        )
    return seen.agg(*facts).select(F.inline(F.array(*rows)))


def type_table(df: DataFrame) -> dict[str, str]:
    """Inferred type by column name; one row per column comes to the driver."""
    return {r.name: r.dtype for r in infer_types(df).collect()}


def with_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns read as the given types; all others stay."""
    text = {name for name, dtype in df.dtypes if dtype == "string"}

    def cast(name: str) -> Column:
        value, wanted = quoted(name), types.get(name, "string")
        if name not in text or wanted == "string":
            return value
        if wanted == "date":
            return parse_date(value).alias(name)
        if wanted == "boolean":
            return (F.lower(F.trim(value)) == "true").alias(name)
        number = F.trim(value).try_cast(wanted)
        return (F.nanvl(number, F.lit(None).cast("double")) if wanted == "double" else number).alias(name)

    return df.select([cast(c) for c in df.columns])
