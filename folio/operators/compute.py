"""Deterministic computations over the documents of a scope and their extracted fields."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DATE_FIELDS = ("issue_date", "effective_date", "expiry_date", "due_date", "signature_date", "date")
#: A classification below this confidence is reported as uncertain.
SURE = 0.6
MAX_RECORDS = 200


def count(scope: DataFrame) -> DataFrame:
    return scope.agg(F.count_distinct("document_id").alias("value"))


def percentage(scope: DataFrame, base: DataFrame) -> DataFrame:
    """Share of the base that is in scope; 0.0 for an empty base."""
    both = base.select("document_id").distinct().join(scope.select("document_id").distinct().withColumn("_in", F.lit(1)), "document_id", "left")
    out = both.agg(F.count("_in").alias("numerator"), F.count("*").alias("denominator"))
    return out.withColumn("value", F.coalesce(F.round(F.try_divide(100 * F.col("numerator"), "denominator"), 1), F.lit(0.0)))


def one_amount(scope: DataFrame, fields: DataFrame, name: str = "total_amount") -> DataFrame:
    """One value for each document and currency: the asked field before 'amount', then the largest."""
    held = fields.where(F.col("name").isin(name, "amount") & F.col("value_num").isNotNull()).join(scope.select("document_id").distinct(), "document_id", "left_semi")
    order = Window.partitionBy("document_id", "unit").orderBy(F.desc(F.col("name") == name), F.desc("value_num"))
    return held.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("document_id", "unit", "value_num")


def first_dates(fields: DataFrame) -> DataFrame:
    """The earliest date of each document, of whatever kind."""
    return fields.where(F.col("name").isin(*DATE_FIELDS) & F.col("value_date").isNotNull()).groupBy("document_id").agg(F.min("value_date").alias("day"))


def amounts(values: DataFrame, how: str = "sum", by: list[str] | None = None) -> DataFrame:
    """sum, average, min or max for each currency (and group); values without currency are never added."""
    f = {"sum": F.sum, "average": F.avg, "min": F.min, "max": F.max}[how]
    return values.where("unit IS NOT NULL").groupBy(*(by or []), F.col("unit").alias("currency")).agg(F.round(f("value_num"), 2).alias("value"), F.count_distinct("document_id").alias("documents"))


def calculation(scope: DataFrame, values: DataFrame) -> DataFrame:
    """How many documents were considered, had a value, and had one without a known currency."""
    held = values.groupBy("document_id").agg(F.bool_or(F.col("unit").isNotNull()).alias("known"))
    both = scope.select("document_id").distinct().join(held, "document_id", "left")
    return both.agg(F.count("*").alias("considered"), F.count("known").alias("with_value"), F.count_if(F.col("known").isNull()).alias("without_value"), F.count_if(~F.col("known")).alias("unknown_currency"))


def period_label(start: date, end: date) -> str:
    """A year, quarter, month, day or range in short."""
    last = (end + timedelta(days=1)).day == 1
    if start.day == 1 and last and start.year == end.year:
        if (start.month, end.month) == (1, 12):
            return str(start.year)
        if start.month == end.month:
            return f"{start:%Y-%m}"
        if start.month % 3 == 1 and end.month == start.month + 2:
            return f"Q{end.month // 3} {start.year}"
    return f"{start}" if start == end else f"{start} to {end}"


def periods(spark, ranges: list[tuple[str, date, date]]) -> DataFrame:
    return spark.createDataFrame([(k, *r) for k, r in enumerate(ranges)], "ordinal int, period string, start date, end date")


def compare_counts(scope: DataFrame, fields: DataFrame, ranges: DataFrame) -> DataFrame:
    """Documents for each period that holds their first date; one may count in several."""
    days = first_dates(fields).join(scope.select("document_id").distinct(), "document_id", "left_semi")
    hits = days.join(F.broadcast(ranges), F.col("day").between(F.col("start"), F.col("end"))).groupBy("ordinal").agg(F.count_distinct("document_id").alias("n"))
    return ranges.join(hits, "ordinal", "left").select("period", F.coalesce("n", F.lit(0)).alias("count"))


def compare_amounts(values: DataFrame, fields: DataFrame, ranges: DataFrame, how: str = "sum") -> DataFrame:
    """Amounts by period; of overlapping periods the last one takes the document."""
    days = first_dates(fields).join(F.broadcast(ranges), F.col("day").between(F.col("start"), F.col("end")))
    days = days.groupBy("document_id").agg(F.max_by("period", "ordinal").alias("period"))
    return amounts(values.join(days, "document_id"), how, ["period"])


def group_documents(scope: DataFrame, column: str, other: str = "other") -> DataFrame:
    return scope.groupBy(F.coalesce(column, F.lit(other)).alias("key")).agg(F.count("*").alias("count"))


def group_dates(scope: DataFrame, fields: DataFrame, form: str) -> DataFrame:
    """Documents by the month (yyyy-MM) or year (yyyy) of their first date; undated ones are left out."""
    days = first_dates(fields).join(scope.select("document_id").distinct(), "document_id", "left_semi")
    return days.groupBy(F.date_format("day", form).alias("key")).agg(F.count("*").alias("count"))


def group_values(scope: DataFrame, fields: DataFrame, name: str, column: str = "value_text") -> DataFrame:
    """Documents for each value of a field; a document with several values counts for each."""
    held = fields.where((F.col("name") == name) & F.col(column).isNotNull()).join(scope.select("document_id").distinct(), "document_id", "left_semi")
    return held.groupBy(F.col(column).alias("key")).agg(F.count_distinct("document_id").alias("count"))


def first_value(fields: DataFrame) -> DataFrame:
    """The most certain value of each field of a document; ties by field id."""
    order = Window.partitionBy("document_id", "name").orderBy(F.desc_nulls_last("confidence"), "field_id")
    return fields.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def lookup(ranked_documents: DataFrame, fields: DataFrame, name: str, documents: int = 3, values: int = 3) -> DataFrame:
    """The first ``values`` values of a field in the first ``documents`` documents (rank, document_id)."""
    top = ranked_documents.where(F.col("rank") <= documents)
    order = Window.partitionBy("document_id").orderBy(F.desc_nulls_last("confidence"), "field_id")
    held = fields.where(F.col("name") == name).join(F.broadcast(top), "document_id")
    return held.withColumn("n", F.row_number().over(order)).where(F.col("n") <= values)


def uncertain(scope: DataFrame) -> DataFrame:
    return scope.agg(F.count_if(F.col("doc_type_confidence") < SURE).alias("uncertain"))


def pending(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count_if(F.col("status").isin("queued", "processing")).alias("pending"))


def records(values: DataFrame) -> DataFrame:
    """The supporting records of a computation: a report of the first ones."""
    return values.orderBy("document_id", "unit").limit(MAX_RECORDS)
