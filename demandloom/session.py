"""Session settings that suit the operators."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Splitting of hot join keys and run-time choice of broadcast joins are left to AQE,
# which measures the real shuffle sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A row sent to Python holds a whole daily series, so batches are kept short.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def get_session(app: str = "demandloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bound_batches(spark: SparkSession, rows: int = int(SETTINGS["spark.sql.execution.arrow.maxRecordsPerBatch"])) -> None:
    """Limits the rows of a batch sent to Python, in sessions that were set up elsewhere too."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def fit_partitions(spark: SparkSession) -> int:
    """Number of tasks that share out the model fits.

    It is given to `repartition` because AQE merges small shuffles by bytes, which would
    put CPU-heavy fits of small series into one task.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
