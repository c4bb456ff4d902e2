"""Counts, percentages, amounts, groupings, comparisons and lookups."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from folio.operators import compute as C
from folio.operators import filters as O
from folio.plans import model as M
from folio.plans.registry import query
from folio.sources.tables import table

W = f"WITH {M.FIELDS_SQL}"
RANGES = [("1993", date(1993, 1, 1), date(1993, 12, 31)), ("1994", date(1994, 1, 1), date(1994, 12, 31)), ("H2 1994", date(1994, 7, 1), date(1995, 6, 30))]
RANGES_SQL = "r(ordinal, period, a, z) AS (VALUES (0, '1993', DATE '1993-01-01', DATE '1993-12-31'), (1, '1994', DATE '1994-01-01', DATE '1994-12-31'), (2, 'H2 1994', DATE '1994-07-01', DATE '1995-06-30'))"


def _values(s, d):
    return C.one_amount(M.order_documents(s, d), M.fields(s, d))


def _by(s, d, column):
    base = M.fields(s, d).where(F.col("name") == column).select("document_id", F.col("value_text").alias("group"))
    return _values(s, d).join(base, "document_id", "left")


@query(f"{W} SELECT count(*) AS value FROM docs WHERE day BETWEEN DATE '1994-01-01' AND DATE '1994-12-31'")
def count_documents(s, d):
    return C.count(O.dated(M.order_documents(s, d), M.fields(s, d), date(1994, 1, 1), date(1994, 12, 31)))


@query("SELECT count(*) FILTER (has_signature) AS numerator, count(*) AS denominator, coalesce(round(100.0 * count(*) FILTER (has_signature) / count(*), 1), 0.0) AS value FROM documents WHERE status = 'indexed'")
def percentage_signed(s, d):
    base = O.indexed(M.documents(s, d))
    return C.percentage(O.signed(base, True), base)


for _how, _f in (("sum", "sum"), ("average", "avg"), ("min", "min"), ("max", "max")):

    def _amounts(s, d, how=_how):
        return C.amounts(_values(s, d), how)

    _amounts.__name__ = f"amount_{_how}"
    query(f"{W} SELECT unit AS currency, round({_f}(value), 2) AS value, count(*) AS documents FROM docs WHERE unit IS NOT NULL GROUP BY unit")(_amounts)

for _column in ("party", "jurisdiction"):

    def _grouped(s, d, column=_column):
        return C.amounts(_by(s, d, column), "sum", ["group"])

    _grouped.__name__ = f"amount_by_{_column}"
    query(f'{W} SELECT {_column} AS "group", unit AS currency, round(sum(value), 2) AS value, count(*) AS documents FROM docs WHERE unit IS NOT NULL GROUP BY {_column}, unit')(_grouped)

for _name, _form, _sqlform in (("month", "yyyy-MM", "%Y-%m"), ("year", "yyyy", "%Y")):

    def _dated_amounts(s, d, form=_form):
        days = C.first_dates(M.fields(s, d)).select("document_id", F.date_format("day", form).alias("group"))
        return C.amounts(_values(s, d).join(days, "document_id", "left"), "sum", ["group"])

    _dated_amounts.__name__ = f"amount_by_{_name}"
    query(f"{W} SELECT strftime(day, '{_sqlform}') AS \"group\", unit AS currency, round(sum(value), 2) AS value, count(*) AS documents FROM docs WHERE unit IS NOT NULL GROUP BY ALL")(_dated_amounts)

    def _group_dates(s, d, form=_form):
        return C.group_dates(M.order_documents(s, d), M.fields(s, d), form)

    _group_dates.__name__ = f"group_by_{_name}"
    query(f"{W} SELECT strftime(day, '{_sqlform}') AS key, count(*) AS count FROM docs GROUP BY ALL")(_group_dates)


@query(f"{W} SELECT status AS \"group\", unit AS currency, round(avg(value), 2) AS value, count(*) AS documents FROM docs WHERE unit IS NOT NULL GROUP BY status, unit")
def amount_by_status(s, d):
    status = M.order_documents(s, d).select("document_id", F.col("status").alias("group"))
    return C.amounts(_values(s, d).join(status, "document_id"), "average", ["group"])


@query(f"{W} SELECT count(*) AS considered, count(*) AS with_value, 0 AS without_value, count(*) FILTER (unit IS NULL) AS unknown_currency FROM docs")
def calculation_record(s, d):
    return C.calculation(M.order_documents(s, d), _values(s, d))


@query(f"{W}, {RANGES_SQL} SELECT period, count(document_id) AS count FROM r LEFT JOIN docs ON day BETWEEN a AND z GROUP BY period")
def compare_counts(s, d):
    return C.compare_counts(M.order_documents(s, d), M.fields(s, d), C.periods(s, RANGES))


@query(f"{W}, {RANGES_SQL}, x AS (SELECT document_id, unit, value, arg_max(period, ordinal) AS period FROM docs JOIN r ON day BETWEEN a AND z GROUP BY ALL) SELECT period, unit AS currency, round(sum(value), 2) AS value, count(*) AS documents FROM x WHERE unit IS NOT NULL GROUP BY ALL")
def compare_amounts(s, d):
    return C.compare_amounts(_values(s, d), M.fields(s, d), C.periods(s, RANGES))


@query("SELECT coalesce(doc_type, 'other') AS key, count(*) AS count FROM documents WHERE status = 'indexed' GROUP BY 1")
def group_by_type(s, d):
    return C.group_documents(O.indexed(M.documents(s, d)), "doc_type")


@query("SELECT coalesce(language, 'und') AS key, count(*) AS count FROM documents WHERE status = 'indexed' GROUP BY 1")
def group_by_language(s, d):
    return C.group_documents(O.indexed(M.documents(s, d)), "language", "und")


@query("SELECT coalesce(status, 'other') AS key, count(*) AS count FROM documents GROUP BY 1")
def group_by_status(s, d):
    return C.group_documents(M.documents(s, d), "status")


@query(f"{W} SELECT jurisdiction AS key, count(DISTINCT document_id) AS count FROM docs GROUP BY 1")
def group_by_jurisdiction(s, d):
    return C.group_values(M.order_documents(s, d), M.fields(s, d), "jurisdiction")


@query(f"{W} SELECT party AS key, count(DISTINCT document_id) AS count FROM docs GROUP BY 1")
def group_by_party(s, d):
    return C.group_values(M.order_documents(s, d), M.fields(s, d), "party")


@query(f"{W} SELECT unit AS key, count(DISTINCT document_id) AS count FROM docs WHERE unit IS NOT NULL GROUP BY 1")
def group_by_currency(s, d):
    return C.group_values(M.order_documents(s, d), M.fields(s, d), "total_amount", "unit")


@query(f"{W} SELECT sum(n) AS total FROM (SELECT count(DISTINCT document_id) AS n FROM docs GROUP BY jurisdiction)")
def group_total(s, d):
    return C.group_values(M.order_documents(s, d), M.fields(s, d), "jurisdiction").agg(F.sum("count").alias("total"))


@query("SELECT document_id, type AS name, value FROM (SELECT *, row_number() OVER (PARTITION BY document_id, type ORDER BY confidence DESC NULLS LAST, page, char_start) AS n FROM entities) WHERE n = 1")
def first_value_per_name(s, d):
    e = table(s, d, "entities").select("document_id", F.col("type").alias("name"), "value", "confidence", F.struct("page", "char_start").alias("field_id"))
    return C.first_value(e).select("document_id", "name", "value")


@query(
    "WITH top AS (SELECT document_id, row_number() OVER (ORDER BY document_id) AS rank FROM (SELECT DISTINCT document_id FROM entities) QUALIFY rank <= 3),"
    " e AS (SELECT DISTINCT document_id, value, page, char_start, confidence FROM entities WHERE type = 'organization')"
    " SELECT rank, document_id, n, value FROM (SELECT rank, document_id, value, row_number() OVER (PARTITION BY document_id ORDER BY confidence DESC NULLS LAST, page, char_start) AS n FROM e JOIN top USING (document_id)) WHERE n <= 3"
)
def lookup_values(s, d):
    e = table(s, d, "entities")
    top = e.select("document_id").distinct().orderBy("document_id").limit(3)
    from pyspark.sql.window import Window

    top = top.withColumn("rank", F.row_number().over(Window.orderBy("document_id")))
    f = e.select("document_id", F.col("type").alias("name"), "value", "confidence", F.struct("page", "char_start").alias("field_id")).distinct()
    return C.lookup(top, f, "organization").select("rank", "document_id", "n", "value")


@query("SELECT count(*) FILTER (doc_type_confidence < 0.6) AS uncertain FROM documents WHERE status = 'indexed'")
def uncertain_count(s, d):
    return C.uncertain(O.indexed(M.documents(s, d)))


@query("SELECT count(*) FILTER (status IN ('queued', 'processing')) AS pending FROM documents")
def pending_count(s, d):
    return C.pending(M.documents(s, d))


@query("SELECT status, count(*) AS documents, coalesce(sum(page_count), 0) AS pages FROM documents GROUP BY status")
def stats(s, d):
    return M.documents(s, d).groupBy("status").agg(F.count("*").alias("documents"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"))


@query(f"{W} SELECT document_id, unit, value AS value_num FROM docs ORDER BY document_id, unit LIMIT 200")
def supporting_records(s, d):
    return C.records(_values(s, d))
