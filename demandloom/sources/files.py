"""CSV and parquet files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.functions.dates import parse_date
from demandloom.schemas import COLUMN_TYPES, MISSING_TEXTS
from demandloom.sources.watch import Watch

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}
#: Text of a row that does not have the header's number of fields; NULL for all others.
RECORD = "_record"
#: A comma outside quotes.
FIELD_END = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def surplus_fields(width: int) -> Column:
    """How many fields a flagged row has beyond the header's; 0 for short rows, whose last fields are missing."""
    fields = F.size(F.split(F.col(RECORD), FIELD_END))
    return F.when(F.col(RECORD).isNull(), 0).otherwise(F.greatest(fields - width, F.lit(0)))


def read_csv(spark: SparkSession, path: str, multi_line: bool = False, on_surplus: str = "raise") -> DataFrame:
    """Every column as text, in one scan; keys such as `001` keep their zeros.

    Texts that mean "missing" become NULL, and so do the last columns of a short row. A row with more
    fields than the header makes the scan fail, as its values may stand in the wrong columns; with
    `on_surplus="flag"` its text is in the further column `_record` instead. `multi_line` allows
    line breaks inside quotes, at the price of files that cannot be split.
    """
    if on_surplus not in ("raise", "flag"):
        raise ValueError(f"on_surplus must be 'raise' or 'flag', not {on_surplus!r}")
    reader = spark.read.options(**CSV_OPTIONS, multiLine=str(multi_line).lower())
    names = reader.csv(path).columns
    if not names:
        return reader.csv(path)
    fields = T.StructType([T.StructField(n, T.StringType()) for n in [*names, RECORD]])
    # A parser that skips columns does not see how many fields a row has.
    raw = reader.schema(fields).option("columnNameOfCorruptRecord", RECORD).option("columnPruning", "false").csv(path)
    surplus = surplus_fields(len(names)) > 0
    values = [F.when(~quoted(c).isin(MISSING_TEXTS), quoted(c)).alias(c) for c in names]
    if on_surplus == "flag":
        return raw.select(*values, F.when(surplus, F.col(RECORD)).alias(RECORD))
    # The message names a column beside the record, as Spark does not read a record alone.
    said = F.concat(F.lit(f"a row has more than {len(names)} fields: "), F.col(RECORD), F.substring(F.coalesce(quoted(names[0]), F.lit("")), 1, 0))
    return raw.where(F.when(surplus, F.raise_error(said).cast("boolean")).otherwise(True)).select(values)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def _number(name: str) -> Column:
    said = F.lower(F.trim(quoted(name)))
    text = F.when(said == "true", "1").when(said == "false", "0").otherwise(quoted(name))
    return F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))


def text_columns(df: DataFrame, kind: str) -> dict[str, str]:
    """Wanted type of each column that a dataset of this kind must have as a date or number and that is text."""
    types = COLUMN_TYPES.get(kind, {})
    return {name: types[name] for name, dtype in df.dtypes if dtype == "string" and name in types}


def typed(df: DataFrame, kind: str, watch: Watch | None = None) -> DataFrame:
    """Known text columns of a dataset kind cast to their types; bad values become NULL.

    `true` and `false` in any case count as 1 and 0 where a number is wanted. A `watch` counts the
    bad values on the way, in the scan that reads them.
    """
    wanted = text_columns(df, kind)
    value = {c: parse_date(quoted(c)) if t == "date" else _number(c).cast(t) for c, t in wanted.items()}
    if watch is None:
        return df.select([value[c].alias(c) if c in wanted else quoted(c) for c in df.columns])
    new = {c: f"_typed_{i}" for i, c in enumerate(wanted)}
    both = df.select("*", *[value[c].alias(n) for c, n in new.items()])
    seen = watch.over(both, {c: (quoted(c).isNotNull() & F.col(n).isNull(), quoted(c)) for c, n in new.items()})
    return seen.select([F.col(new[c]).alias(c) if c in new else quoted(c) for c in df.columns])


def unreadable_rows(df: DataFrame, kind: str) -> DataFrame:
    """The rows that hold a value which `typed` cannot read, with the further column `unreadable`: the names of such columns."""
    wanted = text_columns(df, kind)
    bad = [
        F.when(quoted(c).isNotNull() & (parse_date(quoted(c)) if t == "date" else _number(c)).isNull(), F.lit(c)) for c, t in wanted.items()
    ]
    names = F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")
    return df.withColumn("unreadable", F.array_join(names, ",")).where("unreadable <> ''")
