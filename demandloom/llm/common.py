"""Helpers shared by the document operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words. Python's `bytes.split()` splits at exactly these.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Frequent function words of the four languages, in lower case.
STOP_WORDS = {
    "en": "the of and to in a is that for it was on with as by be are at this from or an not have he his which you we they".split(),
    "fr": "de la le et les des en un une du est que pour dans qui sur pas au par avec ce il plus se".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an bei über".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
}


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table holds, also names that differ in case alone."""
    missing = [n for n in names if n not in docs.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; the table has {docs.columns}")
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return numbered.select([F.col(f"c{docs.columns.index(n)}").alias(n) for n in names])


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, also when lambdas in the body use it often."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; only a local session gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="demandloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def settle(df: DataFrame, label: str, **options: str) -> DataFrame:
    """The rows, written to the shared folder and read again: cuts lineage and survives lost executors.

    Spark deletes the shuffle files of the write once it is done, as nothing needs them any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def settle_hashes(df: DataFrame, label: str) -> DataFrame:
    """Settles rows that are mostly hashes: a dictionary of them costs time and is given up in the end."""
    return settle(df, label, **{"parquet.enable.dictionary": "false"})


def discard(*tables: DataFrame) -> None:
    """Deletes settled tables that no unwritten rows depend on any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shipped(spark: SparkSession, data: bytes, label: str) -> Column:
    """Bytes as a value that plans name but do not hold: Spark prints a literal of their size in every text of a plan."""
    return settle(spark.createDataFrame([(bytearray(data),)], "data binary"), label).scalar()


def bound_batches(spark: SparkSession, rows: int = 256) -> None:
    """Limits the rows of a batch sent to Python, as one row may hold a text of 100 KB or more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
