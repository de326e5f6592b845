"""Tables of a relational database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(
    url: str,
    table: str,
    partition_column: str | None = None,
    lower: object = None,
    upper: object = None,
    partitions: int | None = None,
    **extra: str,
) -> dict[str, str]:
    """Reader options. With a partition column, `partitions` tasks read in parallel."""
    options = {"url": url, "dbtable": table, "fetchsize": "10000", **extra}
    split = {"partitionColumn": partition_column, "lowerBound": lower, "upperBound": upper, "numPartitions": partitions}
    given = {k: str(v) for k, v in split.items() if v is not None}
    if given and len(given) < len(split):
        raise ValueError(f"a split read needs all of {sorted(split)}")
    return {**options, **given}


def read_table(spark: SparkSession, url: str, table: str, **kwargs) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **kwargs)).load()
