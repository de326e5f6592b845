"""Saved forecasts, plans, scenarios and training runs.

Rows of a result stand in a folder of its own, in buckets by SKU where there are SKUs, so that later
joins and sums by SKU need no shuffle. Headers, of which there is one per result, are appended
as small files by day, and packed into one file per day as soon as a few have gathered.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.sources.datasets import read_or_none

#: Loose header files that are packed together.
PACK_AFTER = 6


class ResultNotFound(LookupError):
    pass


class ResultStore:
    """Results under one shared folder. `buckets` must stay the same for the life of a store."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # --- rows of one result

    def save(self, table: str, df: DataFrame, id_column: str, result_id: str) -> None:
        """A rerun of a failed save replaces its own folder only."""
        (
            df.withColumn(id_column, F.lit(result_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(id_column)
            .parquet(f"{self.root}/{table}")
        )

    def save_by_sku(self, table: str, df: DataFrame, id_column: str, result_id: str, dealt: bool = False) -> None:
        """The same in sorted buckets by SKU, one file each.

        `dealt` tells that the rows are dealt by SKU to as many partitions as there are buckets, which spares
        the shuffle.
        """
        rows = df if dealt else df.repartition(self.buckets, "sku")
        name = _table_name()
        try:
            writer = rows.write.mode("overwrite").format("parquet").bucketBy(self.buckets, "sku").sortBy("sku")
            writer.option("path", self._folder(table, id_column, result_id)).saveAsTable(name)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay

    def _folder(self, table: str, id_column: str, result_id: str) -> str:
        return f"{self.root}/{table}/{id_column}={result_id}"

    def by_sku(self, table: str, id_column: str, result_id: str) -> DataFrame | None:
        """Rows saved by `save_by_sku`, known to Spark as bucketed; None if there are none."""
        folder = self._folder(table, id_column, result_id)
        plain = read_or_none(lambda: self.spark.read.parquet(folder))
        if plain is None:
            return None
        name = _table_name()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
        where = folder.replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (sku) SORTED BY (sku) INTO {self.buckets} BUCKETS LOCATION '{where}'"
        )
        try:
            return self.spark.table(name).withColumn(id_column, F.lit(result_id))
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def table(self, table: str) -> DataFrame | None:
        return read_or_none(lambda: self.spark.read.parquet(f"{self.root}/{table}"))

    def rows(self, table: str, id_column: str, result_id: str) -> DataFrame | None:
        """Rows of one result, read from its folder alone; None if it has no rows."""
        base = f"{self.root}/{table}"
        return read_or_none(lambda: self.spark.read.option("basePath", base).parquet(self._folder(table, id_column, result_id)))

    def load(self, table: str, id_column: str, result_id: str) -> DataFrame:
        """Rows of one result; they may be none if the result was saved without rows."""
        found = self.rows(table, id_column, result_id)
        if found is not None:
            return found
        saved = self.table(table)
        if saved is None:
            raise ResultNotFound(f"no {table} saved yet")
        return saved.where(F.lit(False))

    # --- headers

    def add_header(self, table: str, row: DataFrame, id_column: str, result_id: str) -> None:
        """Appends the header row of a result; the result counts as saved from then on."""
        row = row.withColumn(id_column, F.lit(result_id)).withColumn("day", F.date_format(F.current_date(), "yyyy-MM-dd"))
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/{table}/loose")
        if len(self._files(f"{self.root}/{table}/loose/*.parquet")) >= PACK_AFTER:
            self.pack(table, id_column)

    def _files(self, pattern: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(pattern)
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(f.getPath().toString() for f in found or [])

    def _remove(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _packs(self, table: str, day: str = "*") -> list[str]:
        """Finished packs, as folders."""
        done = self._files(f"{self.root}/{table}/packed/{day}/*/_SUCCESS")
        return [f.removesuffix("/_SUCCESS") for f in done]

    def headers(self, table: str, id_column: str) -> DataFrame | None:
        """All header rows, None if there are none. What a broken-off pack left twice counts once."""
        paths = self._packs(table) + self._files(f"{self.root}/{table}/loose/*.parquet")
        if not paths:
            return None
        return self.spark.read.option("mergeSchema", "true").parquet(*paths).dropDuplicates([id_column]).drop("day")

    def pack(self, table: str, id_column: str) -> None:
        """Loose headers join those of their day in one file.

        Nothing is removed before its rows are in a finished pack, and a pack removes only what it has
        read, so two packs at a time or a lost driver lose nothing. A reader whose files went meanwhile
        fails and reads again.
        """
        loose = self._files(f"{self.root}/{table}/loose/*.parquet")
        if not loose:
            return
        rows = self.spark.read.option("mergeSchema", "true").parquet(*loose)
        read = list(loose)
        for (day,) in rows.select("day").distinct().collect():  # at most one day per loose file
            old = self._packs(table, day)
            whole = self.spark.read.option("mergeSchema", "true").parquet(*loose, *old).where(F.col("day") == day)
            whole.dropDuplicates([id_column]).coalesce(1).sortWithinPartitions(id_column).write.parquet(
                f"{self.root}/{table}/packed/{day}/{uuid.uuid4().hex}"
            )
            read += old
        for path in read:
            self._remove(path)

    def one(self, table: str, id_column: str, result_id: str) -> DataFrame:
        """The header row of one result, or the rows of its folder where headers have none."""
        saved = self.headers(table, id_column)
        row = None if saved is None else saved.where(F.col(id_column) == result_id)
        if row is None or row.isEmpty():
            row = self.rows(table, id_column, result_id)
        if row is None:
            raise ResultNotFound(f"{result_id!r} is not in {table}")
        return row

    # --- training state

    def stamps(self, pattern: str) -> dict[str, str]:
        """Path of each file that the pattern names, and a key of its path, size and time of change."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(pattern)
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        parts = {f.getPath().toString(): (f.getLen(), f.getModificationTime()) for f in found}
        return {name: hashlib.md5(f"{name}|{size}|{time}".encode()).hexdigest() for name, (size, time) in parts.items()}

    def known_states(self) -> set[str]:
        done = self._files(f"{self.root}/train_state/*/_SUCCESS")
        return {f.split("/")[-2] for f in done}

    def save_state(self, state: DataFrame, key: str) -> None:
        state.write.mode("overwrite").parquet(f"{self.root}/train_state/{key}")

    def states(self, keys: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/train_state/{k}" for k in keys])

    def log_run(self, run: DataFrame) -> None:
        """Append training results: model_type, metric, value, artifact."""
        (
            run.withColumn("run_id", F.lit(new_id()))
            .withColumn("ts", F.current_timestamp())
            .write.mode("append")
            .parquet(f"{self.root}/runs")
        )


def _table_name() -> str:
    return f"loom_{uuid.uuid4().hex}"


def new_id() -> str:
    return str(uuid.uuid4())
