"""One function per registered query: (spark, data folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    from folio.llm.encode import encode_corpus

    return encode_corpus(_table(spark, folder, "documents"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from folio.llm.split import split_units

    return split_units(_table(spark, folder, "units"), _table(spark, folder, "unit_limits")).where("piece_no = 1").select("unit_id", "boundary")


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    from folio.llm.split import split_units

    return split_units(_table(spark, folder, "units"), _table(spark, folder, "unit_limits"))


def p1_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    from folio.llm.split import rejoined, split_units

    units, limits = _table(spark, folder, "units"), _table(spark, folder, "unit_limits")
    return rejoined(split_units(units, limits), units, limits)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from folio.llm.forms import consistent_text

    return consistent_text(_table(spark, folder, "documents"), only_changed=True).select("doc_id", F.explode("forms").alias("form")).distinct()


def p8_text(spark: SparkSession, folder: str) -> DataFrame:
    from folio.llm.forms import consistent_text

    return consistent_text(_table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    from folio.llm.leaks import find_leaks

    return find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")).select("doc_id", "item_id").distinct()


def _records(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    documents = _table(spark, folder, "documents").select(F.lit("documents").alias("part"), F.col("doc_id").alias("record_id"), "text")
    evidence = _table(spark, folder, "evidence").select(F.lit("evidence").alias("part"), F.col("evidence_id").alias("record_id"), "text")
    return documents.unionByName(evidence)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    from folio.llm.neardup import linked_pairs

    return linked_pairs(_records(spark, folder)).withColumnRenamed("part", "record_kind")


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    from folio.llm.neardup import grouped

    return grouped(_records(spark, folder)).withColumnRenamed("part", "record_kind")


def p5_components(spark: SparkSession, folder: str) -> DataFrame:
    """Each record of enough words with the least record id of its group."""
    from pyspark.sql import functions as F

    from folio.durable import materialize

    groups = materialize(p5_groups(spark, folder).select("record_kind", "record_id", "group_id"))
    first = groups.groupBy("record_kind", "group_id").agg(F.min("record_id").alias("first_id"))
    return groups.join(first, ["record_kind", "group_id"]).select("record_kind", "record_id", "first_id").distinct()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    from folio.llm.language import cases

    return cases(p3_languages(spark, folder))


def p3_languages(spark: SparkSession, folder: str) -> DataFrame:
    from folio.llm.language import identify

    return identify(_table(spark, folder, "documents"), _table(spark, folder, "lang_samples"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    from folio.durable import materialize
    from folio.llm.names import spelling_pairs

    return spelling_pairs(materialize(p4_spellings(spark, folder)))


def p4_spellings(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from folio.llm.names import link_spellings

    filters = _table(spark, folder, "filters")
    parties = filters.select(F.explode("parties").alias("name"))
    signers = filters.select(F.col("signer").alias("name"))
    written = _table(spark, folder, "entities").select(F.col("value").alias("name"))
    return link_spellings(parties.unionByName(signers).unionByName(written))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_text(spark, folder).selectExpr("document_id", "page", "inline(problems)").distinct()


def p2_text(spark: SparkSession, folder: str) -> DataFrame:
    from folio.llm.scans import repair_scans

    return repair_scans(_table(spark, folder, "pages"))
