"""Event windows and the job monitor, for batch and stream alike.

Windows by time are extensions (the reference engine has no stream processing); the monitor keeps
the state of processing jobs: queued, running, done, failed, with retries and stalled heartbeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.durable import materialize

ATTEMPTS, STALLED_AFTER = 5, 120


def _marked(events: DataFrame, late: str | None) -> DataFrame:
    """With a watermark where lateness is given; it needs an instant, not a wall-clock time."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    e = _marked(events, late)
    return e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str | None = None) -> DataFrame:
    e = _marked(events, late)
    return e.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    e = _marked(events, late)
    out = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_content(files: DataFrame, late: str = "1 day") -> DataFrame:
    """Each content of a tenant once within the watermark; a stream's form of registration."""
    return files.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["tenant_id", "sha256"])


STATE = "state string, attempts int, at timestamp, again boolean"
OUT = "document_id string, state string, attempts int"


def _follow(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Events of one job in order of time: queued, running, heartbeat, done, failed."""
    status, attempts, at, again = state.get if state.exists else ("queued", 0, None, False)
    if state.hasTimedOut:  # the run was lost, its attempt counts; a job that may not be tried again is forgotten
        status = "queued" if attempts < ATTEMPTS else "failed"
        if status == "failed":
            state.remove()
        else:
            state.update((status, attempts, at, False))
        yield pd.DataFrame([(key[0], status, attempts)], columns=["document_id", "state", "attempts"])
        return
    for row in pd.concat(list(frames)).sort_values("ts").itertuples():
        at = row.ts
        if row.event == "queued":
            again = status == "running"  # asked for again during a run: not lost
            status = status if again else "queued"
        elif row.event == "running":
            status, attempts = "running", attempts + 1
        elif row.event in ("done", "failed"):
            retry = row.event == "failed" and attempts < ATTEMPTS
            status, again = ("queued", False) if again or retry else (row.event, False)
    state.update((status, attempts, at, again))
    if status == "running":
        state.setTimeoutTimestamp(int(pd.Timestamp(at).timestamp() * 1000) + STALLED_AFTER * 1000)
    yield pd.DataFrame([(key[0], status, attempts)], columns=["document_id", "state", "attempts"])


def monitor(jobs: DataFrame) -> DataFrame:
    """Current state of each job of a stream (document_id, event, ts); a run without a heartbeat is queued
    again, at most ATTEMPTS times."""
    return jobs.withWatermark("ts", "1 minute").groupBy("document_id").applyInPandasWithState(_follow, OUT, STATE, "update", "EventTimeTimeout")


def attempts(jobs: DataFrame) -> DataFrame:
    """The monitor's result over a finished table: runs begun, last event, and whether it may be tried again."""
    g = jobs.groupBy("document_id").agg(F.count_if(F.col("event") == "running").alias("attempts"), F.max_by("event", F.struct("ts", "event")).alias("last"))
    return g.withColumn("retry", (F.col("last") == "failed") & (F.col("attempts") < ATTEMPTS))


def _stored(spark, out: str) -> str | None:
    """The folder of the state that counts, or None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    done = [n for n in names if n.startswith("state=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{n}/_SUCCESS"))]
    return f"{out}/{max(done, key=lambda n: int(n[6:]))}" if done else None


def pages_of(spark, out: str) -> DataFrame:
    """What ingest() holds: the pages of every document once."""
    return spark.read.parquet(_stored(spark, out))


def ingest(files: DataFrame, out: str, checkpoint: str, once: bool = True, quarantine: str | None = None):
    """Continuous ingest: the pages of a micro-batch replace what is stored of their documents, whichever batch
    brought them, and a repeated batch changes nothing. Files that cannot be read go to ``quarantine`` with
    their error and the number of the batch (without it they stay among the pages)."""
    from folio.sources.parsers import parse_files
    from folio.sources.sinks import replace_content

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _stored(spark, out)
        version = int(before.rpartition("=")[2]) + 1 if before else 0
        new = parse_files(batch.dropDuplicates(["content"]))
        if quarantine:
            new = materialize(new)
            new.where("error IS NOT NULL").withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(quarantine)
            new = new.where("error IS NULL")
        kept = replace_content(spark.read.parquet(before), new) if before else new
        kept.write.mode("overwrite").parquet(f"{out}/state={version}")
        if before:  # the one before stays for readers of it; older ones go
            path = spark._jvm.org.apache.hadoop.fs.Path(out)
            fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
            for f in fs.listStatus(path):
                name = f.getPath().getName()
                if name.startswith("state=") and int(name[6:]) < version - 1:
                    fs.delete(f.getPath(), True)

    writer = files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def back_off(attempts: Column, base: int = 30, most: int = 3600) -> Column:
    """Seconds until a failed job is tried again: doubled with each attempt."""
    return F.least(F.lit(most), (F.lit(base) * F.pow(F.lit(2), attempts - 1)).cast("long"))


def queue_metrics(jobs: DataFrame) -> DataFrame:
    """state, jobs, oldest (instant of the last event) by the last event of each job (document_id, event, ts)."""
    last = jobs.groupBy("document_id").agg(F.max_by("event", F.struct("ts", "event")).alias("state"), F.max("ts").alias("at"))
    return last.groupBy("state").agg(F.count("*").alias("jobs"), F.min("at").alias("oldest"))
