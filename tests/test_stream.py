import time
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from folio.streaming import events as E


def test_tumbling_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = E.tumbling(stream, late="365 days").writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert {tuple(r) for r in spark.table("hours").collect()} == {tuple(r) for r in E.tumbling(source.withColumn("ts", source["ts"].cast("timestamp"))).collect()}


def test_monitor(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    schema = "document_id string, event string, ts timestamp"

    def put(rows):
        spark.createDataFrame([(d, e, t0 + timedelta(seconds=s)) for d, e, s in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)

    put([("a", "queued", 0), ("a", "running", 1), ("a", "done", 9), ("b", "running", 1), ("c", "running", 1), ("c", "queued", 2), ("c", "done", 5), ("d", "running", 1), ("d", "failed", 2)])
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = E.monitor(stream).writeStream.outputMode("update").format("memory").queryName("jobs").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        states = {r["document_id"]: (r["state"], r["attempts"]) for r in spark.table("jobs").collect()}
        assert states == {"a": ("done", 1), "b": ("running", 1), "c": ("queued", 1), "d": ("queued", 1)}
        put([("z", "queued", 100_000)])
        q.processAllAvailable()
        put([("z", "running", 100_001)])
        q.processAllAvailable()
        assert ("b", "queued", 1) in {tuple(r) for r in spark.table("jobs").collect()}
    finally:
        q.stop()


def test_ingest_is_idempotent(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("one\n\ntwo")
    for _ in range(2):
        stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(folder))
        E.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert [r["text"] for r in E.pages_of(spark, str(tmp_path / "out")).collect()] == ["one\n\ntwo"]


def test_ingest_replaces_across_batches(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for n, files in enumerate(({"a.txt": "one", "b.txt": "two"}, {"c.txt": "one", "d.pdf": "%PDF-1.4"}, {"e.txt": "three"})):
        for name, text in files.items():
            (folder / name).write_text(text)
        stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(folder))
        E.ingest(stream, out, str(tmp_path / ("cp" if n < 2 else "another")), quarantine=str(tmp_path / "bad")).awaitTermination(60)
    assert sorted(r["text"] for r in E.pages_of(spark, out).collect()) == ["one", "three", "two"]
    assert {r["error"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {"ValueError: no parser for pdf"}


class State:
    """A job's state as the stream keeps it."""

    value, hasTimedOut = None, False
    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, at):
        pass


def test_attempts_survive_stalls():
    state, seen = State(), []
    for n in range(8):
        state.hasTimedOut = False
        events = pd.DataFrame([("running", datetime(2024, 1, 1) + timedelta(hours=n))], columns=["event", "ts"])
        list(E._follow(("a",), iter([events]), state))
        state.hasTimedOut = True
        seen += [tuple(f.iloc[0])[1:] for f in E._follow(("a",), iter([]), state)]
        if seen[-1][0] == "failed":
            break
    assert seen == [("queued", 1), ("queued", 2), ("queued", 3), ("queued", 4), ("failed", 5)] and not state.exists


def test_queue(spark):
    t = datetime(2024, 1, 1)
    jobs = spark.createDataFrame([("a", "queued", t), ("a", "running", t + timedelta(1)), ("b", "queued", t)], "document_id string, event string, ts timestamp")
    assert {tuple(r) for r in E.queue_metrics(jobs).collect()} == {("running", 1, t + timedelta(1)), ("queued", 1, t)}
    waits = spark.range(1, 9).select(E.back_off(F.col("id")).alias("s")).collect()
    assert [r["s"] for r in waits] == [30, 60, 120, 240, 480, 960, 1920, 3600]


def test_first_of_content(spark, tmp_path):
    schema = "tenant_id string, sha256 string, created_at timestamp"
    spark.createDataFrame([("t", "x", datetime(2024, 1, 1)), ("t", "x", datetime(2024, 1, 1, 1)), ("u", "x", datetime(2024, 1, 1))], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = E.first_of_content(stream).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("firsts").count() == 2
