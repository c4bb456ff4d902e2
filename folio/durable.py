"""Cutting lineage so that a lost executor costs a re-read, never a failure."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where the setting is absent and everything runs on this
    machine (tests) a temporary folder stands in for it; a cluster needs the setting."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("folio.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(?:\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="folio-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("folio.checkpoint.dir", folder)
    return folder


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/folio/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Remove this application's tables from the shared folder; no result built on them may be read later.
    Call it when an application has written its results, and between batches of queries."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Unlike checkpoint() the table is compressed and later reads prune its columns; like it,
    the result survives the loss of any executor. The table stays until clear() is called.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_rank(df: DataFrame, name: str, *order) -> DataFrame:
    """Number all rows from 1 in a total order without bringing them into one task: rows are
    range-partitioned, numbered inside their partition, and moved on by the sizes of those before."""
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    ranged = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))  # one row for each partition
    moved = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    numbered = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return numbered.join(F.broadcast(moved), "_part").withColumn(name, F.col("_n") + F.col("_before")).drop("_n", "_before", "_part")
