"""Counts of bad values, taken while a job reads the rows and not in a scan of their own."""

from __future__ import annotations

from threading import Thread

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BAD_VALUES = "dataset string, column string, bad bigint, example string"


class UnreadableValues(ValueError):
    """Values that are present and cannot be read."""


class Watch:
    """Bad values of one dataset, observed on its way through a job.

    The counts are there when the job that reads the rows has ended. If executors were lost and
    tasks ran again they may be too high, but 0 only if there were none. Where Spark left the rows
    out of the job, as when it joins an empty table, a job of their own counts them.
    """

    #: Seconds to wait for counts after the job has ended.
    PATIENCE = 20

    def __init__(self, dataset: str):
        self.dataset = dataset
        self._columns: list[str] = []
        self._seen: dict | None = None

    def over(self, df: DataFrame, bad: dict[str, tuple[Column, Column]]) -> DataFrame:
        """The rows, observed; `bad` gives a test and the text to show for each column."""
        self._columns = list(bad)
        self._facts = [F.count(F.lit(1)).alias("rows")]
        for i, (test, shown) in enumerate(bad.values()):
            self._facts += [F.count_if(test).alias(f"n{i}"), F.min(F.when(test, shown.cast("string"))).alias(f"e{i}")]
        self._observation, self._rows = Observation(), df
        return df.observe(self._observation, *self._facts)

    def _counts(self) -> dict:
        if self._seen is None:
            got: list[dict] = []
            # Spark waits without end for counts of rows that no job has read.
            waiting = Thread(target=lambda: got.append(self._observation.get), daemon=True)
            waiting.start()
            waiting.join(self.PATIENCE)
            self._seen = got[0] if got else {}
            if "rows" not in self._seen:
                self._seen = self._rows.agg(*self._facts).first().asDict()
        return self._seen

    @property
    def rows(self) -> int:
        return self._counts()["rows"]

    def bad(self) -> dict[str, tuple[int, str]]:
        """Number of bad values and one of them, by column; only columns that have any."""
        seen = self._counts()
        return {c: (seen[f"n{i}"], seen[f"e{i}"]) for i, c in enumerate(self._columns) if seen[f"n{i}"]}

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.dataset, c, n, text) for c, (n, text) in self.bad().items()], BAD_VALUES)

    def check(self) -> None:
        """Raises if anything was bad."""
        found = self.bad()
        if found:
            parts = [f"{n} in {column!r} (such as {text!r})" for column, (n, text) in found.items()]
            raise UnreadableValues(f"values of {self.rows} {self.dataset} rows cannot be read: {', '.join(parts)}")
