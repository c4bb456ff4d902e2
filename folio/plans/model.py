"""The engine's model over the stored tables: units as stored last, and the extracted facts as
name/value rows. Orders stand in for documents with amounts, dates, parties and jurisdictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators.index import Index
from folio.operators.postings import latest
from folio.sources.tables import table

#: Currency of a region; one region has none, so that unknown currencies occur.
CURRENCIES = {"AFRICA": "ZAR", "AMERICA": "USD", "ASIA": "JPY", "EUROPE": "EUR"}

FIELDS_SQL = """
  base AS (SELECT o.o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS day, c_name, n_name, o_orderstatus, o_orderpriority,
             CASE r_name WHEN 'AFRICA' THEN 'ZAR' WHEN 'AMERICA' THEN 'USD' WHEN 'ASIA' THEN 'JPY' WHEN 'EUROPE' THEN 'EUR' END AS unit
           FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  docs AS (SELECT CAST(o_orderkey AS VARCHAR) AS document_id, o_orderpriority AS doc_type, o_orderstatus AS status, c_name AS party, n_name AS jurisdiction, day, unit, o_totalprice AS value FROM base)
"""
#: The scanner fold of words x of a table: rules of single characters, one after the other, each by place.
_PLACED = "array_to_string(list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN {1} THEN '{2}' ELSE {0}[i] END), '')"
_BESIDE = "(i > 1 AND regexp_matches({0}[i - 1:i + 1], '^[a-z]{1}[a-z]$'))"


def fold_sql(words: str) -> str:
    """CTEs ending in folds (word, folded) for a query that gives different words as column word."""

    def placed(column: str, signs: str, to: str, *more: str) -> str:
        return _PLACED.format(column, " OR ".join([_BESIDE.format(column, signs), *more]), to)

    zero = ("(i = 1 AND regexp_matches(f0, '^0[a-z]{2}'))", "(i = length(f0) AND regexp_matches(f0, '[a-z]{2}0$'))")
    one = ("(i = 1 AND regexp_matches(f1, '^[1l][a-z]'))", "(i = length(f1) AND regexp_matches(f1, '[a-z][1l]$'))")
    return f"""d0 AS (SELECT word, replace(replace(word, 'rn', 'm'), 'vv', 'w') AS f0 FROM ({words})),
      d1 AS (SELECT *, {placed("f0", "0", "o", *zero)} AS f1 FROM d0), d2 AS (SELECT *, {placed("f1", "[1l]", "i", *one)} AS f2 FROM d1),
      d3 AS (SELECT *, {placed("f2", "5", "s")} AS f3 FROM d2), d4 AS (SELECT *, {placed("f3", "8", "b")} AS f4 FROM d3),
      folds AS (SELECT word, CASE WHEN length(regexp_replace(word, '[^\\p{{L}}]', '', 'g')) > 0 AND 2 * length(regexp_replace(word, '[^\\p{{L}}]', '', 'g')) >= length(word) THEN f4 ELSE word END AS folded FROM d4)"""


def folded_sql(text: str) -> str:
    """SQL of casefold()."""
    written, meant = (x.replace("'", "''") for x in T.compatible())
    found = f"lower(translate({text}, '{written}', '{meant}'))"
    for sign, form in T.joined_forms().items():
        found = f"replace({found}, '{sign}', '{form}')"
    return f"replace({found}, 'ς', 'σ')"


def words_sql(text: str) -> str:
    """SQL of tokens()."""
    return f"regexp_extract_all({folded_sql(text)}, '[\\p{{L}}\\p{{N}}]+')"


UNITS_SQL = f"""
  u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY stored_at DESC NULLS LAST) AS _n FROM units) WHERE _n = 1),
  w AS (SELECT unit_id, document_id, text, {words_sql("text")} AS words FROM u)
"""


def units(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "units"), "unit_id", "stored_at")


def index(spark: SparkSession, d: str) -> Index:
    return Index.stored(spark, d, units(spark, d), documents(spark, d))


def document_fields(spark: SparkSession, d: str) -> DataFrame:
    """Facts that the documents table itself has, in the form of fields(): the day of creation, and the pages as an
    amount in the unit 'pages'."""
    docs = documents(spark, d)
    day = F.struct(F.lit("issue_date").alias("name"), F.lit(None).cast("string").alias("value_text"), F.lit(None).cast("double").alias("value_num"), F.to_date("created_at").alias("value_date"), F.lit(None).cast("string").alias("unit"), F.lit(0).alias("field_id"))
    size = F.struct(F.lit("total_amount").alias("name"), F.lit(None).cast("string").alias("value_text"), F.col("page_count").cast("double").alias("value_num"), F.lit(None).cast("date").alias("value_date"), F.lit("pages").alias("unit"), F.lit(1).alias("field_id"))
    return docs.select("document_id", F.lit(1.0).alias("confidence"), F.inline(F.array(day, size)))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _base(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    placed = orders.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    unit = F.create_map(*[F.lit(x) for kv in CURRENCIES.items() for x in kv])[F.col("r_name")]
    return placed.select(F.col("o_orderkey").cast("string").alias("document_id"), F.to_date("o_orderdate").alias("day"), "o_totalprice", "c_name", "n_name", "o_orderstatus", "o_orderpriority", unit.alias("unit"))


def order_documents(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return orders.select(F.col("o_orderkey").cast("string").alias("document_id"), F.col("o_orderpriority").alias("doc_type"), F.col("o_orderstatus").alias("status"))


def fields(spark: SparkSession, d: str) -> DataFrame:
    """document_id, field_id, name, value_text, value_num, value_date, unit, confidence: one row for each fact.

    All facts of a document come from one row of the join (inline), so the join runs once.
    """
    fact = [
        ("total_amount", None, "o_totalprice", None, "unit"), ("issue_date", None, None, "day", None), ("party", "c_name", None, None, None), ("jurisdiction", "n_name", None, None, None),
    ]
    structs = [
        F.struct(
            F.lit(name).alias("name"), (F.col(t) if t else F.lit(None)).cast("string").alias("value_text"), (F.col(n) if n else F.lit(None)).cast("double").alias("value_num"),
            (F.col(day) if day else F.lit(None)).cast("date").alias("value_date"), (F.col(u) if u else F.lit(None)).cast("string").alias("unit"), F.lit(k).alias("field_id"),
        )
        for k, (name, t, n, day, u) in enumerate(fact)
    ]
    return _base(spark, d).select("document_id", F.lit(1.0).alias("confidence"), F.inline(F.array(*structs)))
