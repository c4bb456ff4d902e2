"""State changes as DataFrames: what a table holds after them. Writers of Parquet overwrite the
partitions concerned; all are idempotent, so a repeated micro-batch changes nothing."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def register(files: DataFrame) -> DataFrame:
    """Each content once a tenant: the first registered stays, the others are marked duplicates of it."""
    first = Window.partitionBy("tenant_id", F.lower("sha256")).orderBy("created_at", "document_id")
    return files.withColumn("duplicate_of", F.first("document_id").over(first)).withColumn("is_duplicate", F.col("duplicate_of") != F.col("document_id"))


def replace_content(stored: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """All rows of the documents in ``new`` are replaced."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def insert_absent(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return stored.unionByName(new.dropDuplicates(key).join(stored.select(*key), key, "left_anti"))


def upsert(stored: DataFrame, new: DataFrame, key: list[str], at: str) -> DataFrame:
    """The latest row of each key; of those of one time the one with the greatest hash."""
    order = Window.partitionBy(*key).orderBy(F.desc_nulls_last(at), F.desc(F.xxhash64(*stored.columns)))
    return stored.unionByName(new).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def delete(stored: DataFrame, gone: DataFrame, key: str = "document_id") -> DataFrame:
    return stored.join(gone.select(key), key, "left_anti")


def prune(vocabulary: DataFrame, postings: DataFrame) -> DataFrame:
    """Words that a posting is left for."""
    return vocabulary.join(postings.select("term"), "term", "left_semi")


def versions(runs: DataFrame) -> DataFrame:
    """Number and state of each run of a document (document_id, at, ended_well): the last good one is current."""
    order = Window.partitionBy("document_id").orderBy("at")
    good = F.max(F.when(F.col("ended_well"), F.col("number"))).over(Window.partitionBy("document_id"))
    state = F.when(~F.col("ended_well"), "failed").when(F.col("number") == good, "current").otherwise("superseded")
    return runs.withColumn("number", F.row_number().over(order)).withColumn("state", state)


def stale(stored: Column, current: dict[str, str]) -> Column:
    """Names of the components (a map column) that differ from the current ones."""
    return F.array_compact(F.array(*[F.when(~stored[name].eqNullSafe(F.lit(value)), F.lit(name)) for name, value in sorted(current.items())]))


def write(df: DataFrame, path: str, partition: str | None = "tenant_id") -> None:
    """Parquet, one folder a tenant; only the partitions in df are overwritten."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def append_audit(spark, path: str, actor: str, action: str, target: str, detail: dict) -> None:
    """One line of the audit, appended; lines are never changed."""
    row = [(actor, action, target, json.dumps(detail, sort_keys=True))]
    spark.createDataFrame(row, "actor string, action string, target string, detail string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)
