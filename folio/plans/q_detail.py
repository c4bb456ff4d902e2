"""Details of documents: languages, titles, grids, key fields, figures, audit."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import extract as X
from folio.functions import text as T
from folio.functions.chunks import document_unit, labelled_row
from folio.operators import answers as A
from folio.operators.meaning import embedding_input
from folio.plans import model as M
from folio.plans.registry import query
from folio.sources.tables import table

_HITS = ", ".join(f"row(len(list_filter(w, lambda x: x IN ({', '.join(chr(39) + x + chr(39) for x in held.split())}))), '{code}')" for code, held in T.LANGUAGE_WORDS.items())


@query(
    f"WITH t AS (SELECT doc_id, {M.words_sql('text')} AS w FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, len(w) AS n, list_max([{_HITS}]) AS best FROM t)"
    " SELECT doc_id, CASE WHEN n >= 8 AND best[1] >= greatest(2.0, 0.04 * n) THEN best[2] ELSE 'und' END AS language FROM b"
)
def language_by_words(s, d):
    return M.documents(s, d).where("text IS NOT NULL").select("doc_id", T.language(T.tokens(F.col("text"))).alias("language"))


@query(
    "WITH f AS (SELECT doc_id, trim(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0)[1]) AS line FROM documents)"
    " SELECT doc_id, CASE WHEN length(line) BETWEEN 3 AND 120 AND length(regexp_replace(line, '[^\\p{L}]', '', 'g')) >= 3 THEN line END AS title FROM f"
)
def guessed_titles(s, d):
    return M.documents(s, d).select("doc_id", T.guess_title(F.col("text")).alias("title"))


@query("SELECT doc_id, 'from https://' || source || '.example/' || filename || '?… on' AS text FROM documents WHERE source IS NOT NULL AND NOT regexp_matches(source || filename, '[\\s?#]')")
def redacted_urls(s, d):
    """Addresses made of the table's columns, as the texts hold none."""
    docs = M.documents(s, d).where(F.col("source").isNotNull() & ~F.concat("source", "filename").rlike(r"[\s?#]"))
    url = F.concat(F.lit("from https://"), "source", F.lit(".example/"), "filename", F.lit("?key="), "document_id", F.lit("&x=1 on"))
    return docs.select("doc_id", T.redact_url(url).alias("text"))


@query(f"WITH {M.UNITS_SQL} SELECT document_id, page, list(list_transform(string_split(text, '|'), lambda x: trim(x)) ORDER BY ordinal, unit_id) AS grid FROM u WHERE unit_type = 'table_row' GROUP BY document_id, page")
def table_grid(s, d):
    """Rows of tables as a grid for each page; a page of a sheet has a bounded number of rows."""
    rows = M.units(s, d).where("unit_type = 'table_row'").select("document_id", "page", "ordinal", "unit_id", F.transform(F.split("text", r"\|"), lambda x: F.trim(x)).alias("cells"))
    return rows.groupBy("document_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "unit_id", "cells"))), lambda x: x["cells"]).alias("grid"))


@query(
    "WITH f AS (SELECT document_id, type, value, row_number() OVER (PARTITION BY document_id, type ORDER BY confidence DESC NULLS LAST, page, char_start) AS n FROM entities)"
    " SELECT document_id, max(value) FILTER (type = 'organization') AS organization, max(value) FILTER (type = 'person') AS person FROM f WHERE n = 1 GROUP BY document_id"
)
def key_fields(s, d):
    order = Window.partitionBy("document_id", "type").orderBy(F.desc_nulls_last("confidence"), "page", "char_start")
    first = table(s, d, "entities").withColumn("n", F.row_number().over(order)).where("n = 1")
    return first.groupBy("document_id").pivot("type", ["organization", "person"]).agg(F.max("value"))


_NUMBER = "([0-9][0-9,]*(?:\\.[0-9]+)?)"


@query(
    f"WITH p AS (SELECT DISTINCT document_id, page, text FROM pages), f AS (SELECT document_id, page, coalesce(nullif(regexp_extract(text, '(?i)\\bday\\w*\\b[^.\\n0-9]{{0,40}}?{_NUMBER}', 1), ''),"
    f" nullif(regexp_extract(text, '(?i)\\(?{_NUMBER}\\)?\\s+(?:[a-z]+\\s+){{0,2}}day\\w*\\b', 1), '')) AS figure FROM p) SELECT document_id, page, figure FROM f WHERE figure IS NOT NULL"
)
def stated_figures(s, d):
    """The number that each page gives for days."""
    pages = table(s, d, "pages").select("document_id", "page", "text").distinct()
    return pages.select("document_id", "page", A.stated_figure(F.col("text"), "days").alias("figure")).where("figure IS NOT NULL")


@query("SELECT document_id, 'register' AS action, created_at AS at, json_object('file', filename, 'kind', kind) AS detail FROM documents UNION ALL SELECT document_id, 'index', indexed_at, json_object('file', filename, 'kind', kind) FROM documents WHERE indexed_at IS NOT NULL")
def audit_events(s, d):
    docs = M.documents(s, d).withColumn("detail", F.to_json(F.struct(F.col("filename").alias("file"), "kind")))
    made = docs.select("document_id", F.lit("register").alias("action"), F.col("created_at").alias("at"), "detail")
    return made.unionByName(docs.where("indexed_at IS NOT NULL").select("document_id", F.lit("index").alias("action"), F.col("indexed_at").alias("at"), "detail"))


@query("SELECT kind, status, count(*) AS documents, coalesce(sum(page_count), 0) AS pages FROM documents GROUP BY ROLLUP (kind, status)")
def stats_rollup(s, d):
    """An extension: subtotals in one pass."""
    return M.documents(s, d).rollup("kind", "status").agg(F.count("*").alias("documents"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"))


@query("SELECT document_id, concat_ws(chr(10), title, replace(doc_type, '_', ' '), filename, 'pages: ' || page_count) AS text FROM documents")
def document_units(s, d):
    pages = F.concat(F.lit("pages: "), F.col("page_count").cast("string"))
    return M.documents(s, d).select("document_id", document_unit(F.col("title"), F.col("doc_type"), F.col("filename"), pages).alias("text"))


@query(
    f"WITH {M.UNITS_SQL} SELECT unit_id, array_to_string(list_filter(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN r[i] = '' THEN NULL WHEN coalesce(h[i], '') <> '' THEN h[i] || ': ' || r[i] ELSE r[i] END), lambda x: x IS NOT NULL), '; ') AS text"
    " FROM (SELECT unit_id, list_transform(string_split(context, '|'), lambda x: trim(x)) AS h, list_transform(string_split(text, '|'), lambda x: trim(x)) AS r FROM u WHERE unit_type = 'table_row' AND context IS NOT NULL)"
)
def labelled_rows(s, d):
    return M.units(s, d).where("unit_type = 'table_row' AND context IS NOT NULL").select("unit_id", labelled_row(F.col("context"), F.col("text")).alias("text"))


@query(f"WITH {M.UNITS_SQL} SELECT unit_id, concat_ws(chr(10), nullif(title, ''), nullif(context, ''), u.text) AS text FROM u JOIN documents USING (document_id)")
def embedding_inputs(s, d):
    docs = M.documents(s, d).select("document_id", "title")
    return M.units(s, d).join(docs, "document_id").select("unit_id", embedding_input(F.col("title"), F.col("context"), F.col("text")).alias("text"))


@query(
    "SELECT DISTINCT document_id, value AS subject, CASE WHEN type = 'organization' THEN 'party_to' ELSE 'signed' END AS name, document_id AS object FROM entities WHERE type = 'organization' OR (type = 'person' AND role = 'signer')"
    f" UNION ALL SELECT document_id, document_id, 'governed_by', jurisdiction FROM (WITH {M.FIELDS_SQL} SELECT DISTINCT document_id, jurisdiction FROM docs)"
)
def derived_relations(s, d):
    return X.derived_relations(M.fields(s, d), table(s, d, "entities"))


def _score_sql(words: dict[str, float]) -> str:
    return " + ".join(["0.0::DOUBLE", *(f"{w}::DOUBLE * (least(3.0::DOUBLE, (length(low) - length(replace(low, '{k}', ''))) / {len(k)}.0::DOUBLE) + CASE WHEN contains(head, '{k}') THEN 2.0 ELSE 0.0 END)" for k, w in words.items())])


@query(
    "WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS low, lower(coalesce(title, '')) AS head FROM documents),"
    f" r AS (SELECT doc_id, list_sort([{', '.join(f"{{'score': {_score_sql(words)}, 'kind': '{kind}'}}" for kind, words in X.TYPE_WORDS.items())}], 'DESC') AS s FROM t),"
    " f AS (SELECT doc_id, s[1].kind AS kind, s[1].score AS top, s[2].score AS second FROM r)"
    " SELECT doc_id, CASE WHEN top > 0 THEN kind ELSE 'other' END AS doc_type, CASE WHEN top >= 2.5 THEN round(greatest(0.35, least(0.98, 0.55 + 0.08 * top) * (1 - 0.45 * second / top)), 6) WHEN top > 0 THEN 0.4 ELSE 0.5 END AS confidence,"
    " CASE WHEN top >= 2.5 THEN 'rules' WHEN top > 0 THEN 'rules_weak' ELSE 'none' END AS method FROM f"
)
def document_types(s, d):
    return M.documents(s, d).select("doc_id", X.classified(F.col("title"), F.col("text")).alias("c")).select("doc_id", "c.*")
