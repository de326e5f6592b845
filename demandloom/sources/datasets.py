"""Uploaded and sample datasets by kind."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from demandloom.schemas import COLUMN_TYPES, KINDS
from demandloom.sources.files import RECORD, read_csv, typed
from demandloom.sources.infer import type_table, with_types
from demandloom.sources.watch import UnreadableValues, Watch

LOG_SCHEMA = "kind string, version string, path string, rows bigint, uploaded_at timestamp, bad_rows bigint, types string"


class DatasetNotFound(LookupError):
    pass


def read_or_none(read) -> DataFrame | None:
    """The DataFrame, or None when its folder does not exist or holds no rows yet."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


class Datasets:
    """Datasets under one shared folder.

    Each upload is written beside the old ones as parquet, and becomes current only when its
    line is appended to the log. A failed upload thus never harms the dataset in use.
    Samples are `sample_<kind>.csv` files in the same folder.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def upload(self, kind: str, path: str, multi_line: bool = False, on_bad: str = "raise") -> DataFrame:
        """Stores a CSV file with the types of its columns; `multi_line` allows line breaks inside quotes.

        Rows with more fields than the header raise, and the upload does not become current. With
        `on_bad="quarantine"` they are kept apart, see `bad_rows`.
        """
        if kind not in KINDS:
            raise ValueError(f"dataset kind must be one of {KINDS}, not {kind!r}")
        if on_bad not in ("raise", "quarantine"):
            raise ValueError(f"on_bad must be 'raise' or 'quarantine', not {on_bad!r}")
        if not path.lower().endswith(".csv"):
            raise ValueError("only .csv files can be uploaded")
        raw = read_csv(self.spark, path, multi_line, on_surplus="flag")
        if not raw.columns:
            raise ValueError(f"{path} has no columns")
        version = uuid.uuid4().hex
        target = f"{self.root}/uploads/{kind}/{version}"
        raw.write.parquet(target)
        stored = self.spark.read.schema(raw.schema).parquet(target)
        good = stored.where(F.col(RECORD).isNull()).drop(RECORD)
        counts = stored.agg(F.count_if(F.col(RECORD).isNull()), F.count(RECORD), F.min(RECORD)).first()
        if counts[1] and on_bad == "raise":
            raise UnreadableValues(f"{counts[1]} rows of {path} have more fields than its header, such as {counts[2]!r}")
        types = {c: t for c, t in type_table(good).items() if c not in COLUMN_TYPES.get(kind, {})}
        line = self.spark.range(1).select(
            F.lit(kind).alias("kind"), F.lit(version).alias("version"), F.lit(target).alias("path"),
            F.lit(counts[0]).cast("bigint").alias("rows"), F.current_timestamp().alias("uploaded_at"),
            F.lit(counts[1]).cast("bigint").alias("bad_rows"), F.lit(json.dumps(types)).alias("types"),
        )
        line.write.mode("append").parquet(f"{self.root}/uploads_log")
        return with_types(typed(good, kind), types)

    def uploads(self) -> DataFrame | None:
        return read_or_none(lambda: self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.root}/uploads_log"))

    def _newest(self, kind: str) -> Row | None:
        log = self.uploads()
        if log is None:
            return None
        lines = log.where(F.col("kind") == kind)
        found = lines.agg(F.max_by(F.struct("path", "types"), F.struct("uploaded_at", "version")).alias("line")).first().line
        return found

    def location(self, kind: str) -> tuple[str, str] | None:
        """(`uploaded` or `sample`, path) of the dataset in use; None when there is none."""
        newest = self._newest(kind)
        if newest is not None:
            return "uploaded", newest.path
        sample = f"{self.root}/sample_{kind}.csv"
        if kind in KINDS and read_or_none(lambda: self.spark.read.text(sample)) is not None:
            return "sample", sample
        return None

    def _stored(self, kind: str) -> tuple[DataFrame, DataFrame | None, dict[str, str] | None]:
        """Rows as text, the rows kept apart, and the types found at the upload, if the dataset is one."""
        newest = self._newest(kind)
        if newest is None:
            found = self.location(kind)
            if found is None:
                raise DatasetNotFound(f"dataset {kind!r} is not available")
            return read_csv(self.spark, found[1]), None, None
        stored = self.spark.read.parquet(newest.path)
        if RECORD not in stored.columns:
            return stored, None, json.loads(newest.types or "{}")
        bad = stored.where(F.col(RECORD).isNotNull()).select(F.col(RECORD).alias("record"))
        return stored.where(F.col(RECORD).isNull()).drop(RECORD), bad, json.loads(newest.types or "{}")

    def read(self, kind: str, watch: Watch | None = None) -> DataFrame:
        """The dataset with the types of its kind, and inferred ones for its other text columns.

        An upload's types were inferred when it was stored; a sample's are in a scan of its own. A
        `watch` counts the values that do not have their kind's type.
        """
        raw, _, types = self._stored(kind)
        if types is None:
            known = COLUMN_TYPES.get(kind, {})
            types = {c: t for c, t in type_table(raw).items() if c not in known}
        return with_types(typed(raw, kind, watch), types)

    def bad_rows(self, kind: str) -> DataFrame:
        """Text of the rows that the upload in use keeps apart."""
        bad = self._stored(kind)[1]
        return self.spark.createDataFrame([], "record string") if bad is None else bad
