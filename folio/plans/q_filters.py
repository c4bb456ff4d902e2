"""Filters, listings, state changes and set operations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from folio.operators import filters as O
from folio.plans import model as M
from folio.plans.registry import query
from folio.sources import sinks as S
from folio.sources.tables import table

IDS = "SELECT document_id FROM"


@query("SELECT document_id FROM documents WHERE status = 'indexed' AND doc_type IN ('memo', 'nda')")
def filter_type(s, d):
    return O.of_types(O.indexed(M.documents(s, d)), ["memo", "nda"]).select("document_id")


@query("SELECT document_id FROM documents WHERE status = 'indexed' AND kind IN ('native', 'office') AND file_ext IN ('.pdf', '.docx')")
def filter_kind(s, d):
    return O.of_kinds(O.indexed(M.documents(s, d)), ["native", "office"], [".pdf", ".docx"]).select("document_id")


@query("SELECT document_id FROM documents WHERE has_signature IS TRUE")
def filter_signed(s, d):
    return O.signed(M.documents(s, d), True).select("document_id")


@query("SELECT document_id FROM documents WHERE has_signature IS NOT TRUE")
def filter_unsigned(s, d):
    return O.signed(M.documents(s, d), False).select("document_id")


@query(f"WITH {M.FIELDS_SQL} SELECT document_id FROM docs WHERE jurisdiction IN ('NATION_6', 'NATION_7')")
def filter_jurisdiction(s, d):
    return O.in_jurisdictions(M.order_documents(s, d), M.fields(s, d), ["NATION_6", "NATION_7"]).select("document_id")


@query(
    "SELECT document_id FROM documents d WHERE EXISTS (SELECT 1 FROM entities e WHERE e.document_id = d.document_id AND type = 'person' AND role = 'signer'"
    " AND (contains(regexp_replace(trim(lower(value_norm)), '\\s+', ' ', 'g'), 'leonard') OR starts_with('leonard', regexp_replace(trim(lower(value_norm)), '\\s+', ' ', 'g') || ' ')))"
)
def filter_signer(s, d):
    return O.signed_by(M.documents(s, d), table(s, d, "entities"), "Leonard").select("document_id")


@query(
    f"WITH {M.UNITS_SQL}, p AS (SELECT document_id FROM entities WHERE type IN ('person', 'organization') AND contains(array_to_string({M.words_sql('value_norm')}, ' '), 'services corp')"
    " UNION SELECT document_id FROM w WHERE contains(' ' || array_to_string(words, ' ') || ' ', ' services corp ')) SELECT document_id FROM documents WHERE document_id IN (SELECT document_id FROM p)"
)
def filter_party(s, d):
    return O.with_party(M.documents(s, d), table(s, d, "entities"), M.index(s, d).phrase("Services Corp"), "Services Corp").select("document_id")


@query(f"WITH {M.FIELDS_SQL} SELECT document_id FROM docs WHERE day BETWEEN DATE '1995-01-01' AND DATE '1995-03-31'")
def filter_date(s, d):
    return O.dated(M.order_documents(s, d), M.fields(s, d), date(1995, 1, 1), date(1995, 3, 31)).select("document_id")


@query(f"WITH {M.FIELDS_SQL} SELECT document_id FROM docs WHERE value BETWEEN 100000 AND 150000 AND unit = 'EUR'")
def filter_amount(s, d):
    return O.of_amount(M.order_documents(s, d), M.fields(s, d), "between", 150000, 100000, "EUR").select("document_id")


@query("SELECT document_id FROM documents WHERE document_id IN (SELECT document_id FROM clauses WHERE clause_type IN ('termination', 'payment'))")
def filter_clause(s, d):
    return O.with_clauses(M.documents(s, d), table(s, d, "clauses"), ["termination", "payment"]).select("document_id")


@query("SELECT document_id, indexed_at FROM documents ORDER BY indexed_at DESC NULLS LAST, document_id LIMIT 20")
def listing_newest(s, d):
    return O.listing(M.documents(s, d)).select("document_id", "indexed_at")


@query("SELECT document_id FROM documents WHERE filename ILIKE '%warranty%' ORDER BY indexed_at DESC NULLS LAST, document_id LIMIT 10 OFFSET 10")
def listing_page(s, d):
    return O.listing(O.named_like(M.documents(s, d), "warranty"), 10, 10).select("document_id")


@query("SELECT document_id, first_value(document_id) OVER (PARTITION BY tenant_id, lower(sha256) ORDER BY created_at, document_id) AS duplicate_of FROM documents")
def dedupe_first(s, d):
    return S.register(M.documents(s, d)).select("document_id", "duplicate_of")


@query("SELECT unit_id, stored_at FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY stored_at DESC NULLS LAST) AS n FROM units) WHERE n = 1")
def upsert_units(s, d):
    u = table(s, d, "units")
    return S.upsert(u.limit(0), u, ["unit_id"], "stored_at").select("unit_id", "stored_at")


@query("SELECT document_id, page, char_start FROM clauses WHERE clause_type <> 'payment' AND document_id NOT IN (SELECT document_id FROM clauses WHERE clause_type = 'payment') UNION ALL SELECT document_id, page, char_start FROM clauses WHERE clause_type = 'payment'")
def replace_clauses(s, d):
    c = table(s, d, "clauses").select("document_id", "page", "char_start", "clause_type")
    return S.replace_content(c, c.where("clause_type = 'payment'")).drop("clause_type")


@query("SELECT document_id, type, value FROM entities e WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.document_id = e.document_id AND d.kind = 'office')")
def delete_documents(s, d):
    return S.delete(table(s, d, "entities"), M.documents(s, d).where("kind = 'office'")).select("document_id", "type", "value")


@query("SELECT DISTINCT document_id, type FROM entities")
def insert_absent(s, d):
    e = table(s, d, "entities").select("document_id", "type")
    return S.insert_absent(e.where("type = 'person'").distinct(), e, ["document_id", "type"])


@query(
    "WITH r AS (SELECT document_id, page, ocr_confidence IS NOT NULL AS ok FROM (SELECT DISTINCT document_id, page, ocr_confidence FROM pages)),"
    " n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page) AS number FROM r), m AS (SELECT *, max(CASE WHEN ok THEN number END) OVER (PARTITION BY document_id) AS good FROM n)"
    " SELECT document_id, page, number, CASE WHEN NOT ok THEN 'failed' WHEN number = good THEN 'current' ELSE 'superseded' END AS state FROM m"
)
def version_states(s, d):
    runs = table(s, d, "pages").select("document_id", "page", "ocr_confidence").distinct()
    runs = runs.select("document_id", "page", F.col("page").alias("at"), F.col("ocr_confidence").isNotNull().alias("ended_well"))
    return S.versions(runs).select("document_id", "page", "number", "state")


@query("SELECT document_id, list_filter([CASE WHEN kind IS DISTINCT FROM 'native' THEN 'parser' END, CASE WHEN language IS DISTINCT FROM 'en' THEN 'model' END], lambda x: x IS NOT NULL) AS stale FROM (SELECT document_id, kind, language FROM documents)")
def stale_components(s, d):
    docs = M.documents(s, d).select("document_id", F.create_map(F.lit("parser"), "kind", F.lit("model"), "language").alias("c"))
    return docs.select("document_id", F.reverse(S.stale(F.col("c"), {"parser": "native", "model": "en"})).alias("stale"))


@query("SELECT document_id FROM clauses WHERE clause_type = 'termination' INTERSECT SELECT document_id FROM clauses WHERE clause_type = 'payment'")
def set_intersection(s, d):
    c = table(s, d, "clauses")
    return c.where("clause_type = 'termination'").select("document_id").intersect(c.where("clause_type = 'payment'").select("document_id"))


@query("SELECT document_id FROM clauses WHERE clause_type = 'termination' EXCEPT SELECT document_id FROM clauses WHERE clause_type = 'payment'")
def set_difference(s, d):
    c = table(s, d, "clauses")
    return c.where("clause_type = 'termination'").select("document_id").subtract(c.where("clause_type = 'payment'").select("document_id"))


@query("SELECT document_id, list_sort(list_distinct(list(clause_type))) AS types, len(list_filter(list_distinct(list(clause_type)), lambda x: x NOT IN ('payment', 'warranty', 'termination'))) = 0 AS subset FROM clauses GROUP BY document_id")
def set_subset(s, d):
    g = table(s, d, "clauses").groupBy("document_id").agg(F.array_sort(F.collect_set("clause_type")).alias("types"))
    return g.withColumn("subset", F.size(F.array_except("types", F.array(*map(F.lit, ("payment", "warranty", "termination"))))) == 0)


@query("SELECT document_id, list(clause_type ORDER BY page, char_start, clause_type) AS clauses FROM (SELECT DISTINCT document_id, page, char_start, clause_type FROM clauses) GROUP BY document_id")
def document_detail(s, d):
    c = table(s, d, "clauses").select("document_id", "page", "char_start", "clause_type").distinct()
    ordered = F.array_sort(F.collect_list(F.struct("page", "char_start", "clause_type")))
    return c.groupBy("document_id").agg(F.transform(ordered, lambda x: x["clause_type"]).alias("clauses"))
