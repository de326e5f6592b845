"""Streams that break off between a batch's write and its commit."""

import json

import pytest

from demandloom.streaming import publish as module
from demandloom.streaming.publish import SentBatches, publish_once


@pytest.fixture
def stream(spark, tmp_path):
    def add(k, rows):
        spark.createDataFrame(rows, "id long, name string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    add(0, [(1, "a"), (2, None)])
    df = spark.readStream.schema("id long, name string").option("maxFilesPerTrigger", "1").json(str(tmp_path / "in"))
    options = {"path": str(tmp_path / "out"), "checkpointLocation": str(tmp_path / "cp")}

    def sent():
        return sorted(json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "out")).collect())

    return df, options, add, sent


def test_a_restart_finds_nothing_new(stream):
    df, options, add, sent = stream
    for _ in range(2):
        publish_once(df, "t", "text", **options).awaitTermination()
    assert sent() == [1, 2]
    add(1, [(3, "c")])
    publish_once(df, "t", "text", **options).awaitTermination()
    assert sent() == [1, 2, 3]


@pytest.mark.parametrize("lost", ["after the log", "before the log"])
def test_a_driver_lost_between_write_and_commit(stream, monkeypatch, lost):
    df, options, add, sent = stream
    add_entry = SentBatches.add

    def break_off(self, batch_id):
        if lost == "after the log":
            add_entry(self, batch_id)
        raise RuntimeError("driver lost")

    monkeypatch.setattr(SentBatches, "add", break_off)
    with pytest.raises(Exception, match="driver lost"):
        publish_once(df, "t", "text", **options).awaitTermination()
    assert sent() == [1, 2]  # written, but not committed
    monkeypatch.undo()
    add(1, [(3, "c"), (4, "d")])
    publish_once(df, "t", "text", **options).awaitTermination()
    assert sent() == [1, 2, 3, 4]


def test_a_sent_batch_is_not_written_again(stream, monkeypatch):
    df, options, add, sent = stream
    publish_once(df, "t", "text", **options).awaitTermination()
    calls = []
    original = module._for_sink
    monkeypatch.setattr(module, "_for_sink", lambda *a: calls.append(a) or original(*a))
    # The checkpoint forgets its last commit, as when the driver was lost before it.
    import glob
    import os

    for name in glob.glob(f"{options['checkpointLocation']}/commits/*") + glob.glob(f"{options['checkpointLocation']}/commits/.*crc"):
        os.remove(name)
    publish_once(df, "t", "text", **options).awaitTermination()
    assert sent() == [1, 2] and not calls


def test_wrong_uses(spark, stream):
    df, options, _, _ = stream
    with pytest.raises(ValueError, match="checkpointLocation"):
        publish_once(df, "t", "text", path="x")
    with pytest.raises(ValueError, match="path"):
        publish_once(df, "t", "text", checkpointLocation="x")
    with pytest.raises(ValueError, match="stream"):
        publish_once(spark.range(1), "t", "text", **options)
