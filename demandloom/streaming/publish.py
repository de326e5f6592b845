"""Rows published as JSON events, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_events(df: DataFrame, topic: str) -> DataFrame:
    """(topic, value): each row as a JSON object, missing values written as null."""
    value = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select(F.lit(topic).alias("topic"), value.alias("value"))


def _for_sink(df: DataFrame, topic: str, sink: str) -> DataFrame:
    events = as_events(df, topic)
    return events if sink == "kafka" else events.select("value")


def _stream_options(df: DataFrame, every: str | None, options: dict[str, str]) -> dict:
    if "checkpointLocation" not in options:
        raise ValueError("a stream needs a checkpointLocation on shared storage")
    return {"processingTime": every} if every else {"availableNow": True}


def publish(df: DataFrame, topic: str, sink: str = "kafka", every: str | None = None, **options: str):
    """Write a batch, or start a stream when `df` is one (give it a `checkpointLocation`).

    A stream takes what is there and stops, or runs on in intervals of `every`.

    The `kafka` sink needs the Spark-Kafka connector and `kafka.bootstrap.servers`; file sinks
    get the JSON text only and need `path`.
    """
    events = _for_sink(df, topic, sink)
    if not df.isStreaming:
        return events.write.format(sink).mode("append").options(**options).save()
    trigger = _stream_options(df, every, options)
    return events.writeStream.format(sink).options(**options).trigger(**trigger).start()


class SentBatches:
    """Log of the batches of one stream that have been sent: an empty file each, beside the stream's checkpoint."""

    def __init__(self, spark: SparkSession, checkpoint: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._root = f"{checkpoint.rstrip('/')}/sent"
        self._fs = self._path(self._root).getFileSystem(spark._jsc.hadoopConfiguration())

    def __contains__(self, batch_id: int) -> bool:
        return self._fs.exists(self._path(f"{self._root}/{batch_id}"))

    def add(self, batch_id: int) -> None:
        self._fs.create(self._path(f"{self._root}/{batch_id}"), True).close()


def publish_once(df: DataFrame, topic: str, sink: str = "kafka", every: str | None = None, **options: str):
    """A stream that sends no batch again after a lost driver.

    Spark repeats the batch that it had not yet committed, with the same number and rows. A batch that
    the log holds is skipped. Between sending and the log's entry a file sink is safe as well, as
    a repeated batch replaces its own folder under `path`, `batch=<number>`. The `kafka` sink may send
    a batch twice in that gap alone; its messages carry the key `<topic>-<batch>-<hash of the value>`, the same
    each time, for consumers that must drop them.
    """
    if not df.isStreaming:
        raise ValueError("only a stream has batches to repeat; use publish")
    trigger = _stream_options(df, every, options)
    rest = dict(options)
    checkpoint = rest.pop("checkpointLocation")
    if sink != "kafka" and "path" not in rest:
        raise ValueError("a file sink needs a path")
    log = SentBatches(df.sparkSession, checkpoint)

    def send(batch: DataFrame, batch_id: int) -> None:
        if batch_id in log:
            return
        events = _for_sink(batch, topic, sink)
        if sink == "kafka":
            key = F.concat_ws("-", F.lit(topic), F.lit(str(batch_id)), F.xxhash64("value").cast("string"))
            events.withColumn("key", key).write.format(sink).options(**rest).save()
        else:
            folder = f"{rest['path'].rstrip('/')}/batch={batch_id}"
            events.write.format(sink).mode("overwrite").options(**{k: v for k, v in rest.items() if k != "path"}).save(folder)
        log.add(batch_id)

    return df.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(**trigger).start()
