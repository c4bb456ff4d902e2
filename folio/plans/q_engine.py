"""Whole questions, run by the engine over the whole collection."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators.engine import Engine, TenantCatalog
from folio.plans import model as M
from folio.plans.registry import query

W = f"WITH {M.UNITS_SQL}"
TODAY = date(2026, 1, 1)
INDEXED = "document_id IN (SELECT document_id FROM documents WHERE status = 'indexed')"


def _engine(s, d) -> Engine:
    return Engine(TenantCatalog(s, d, None), M.document_fields(s, d))


@query("SELECT '2024' AS period, count(*) FILTER (year(created_at) = 2024) AS count FROM documents WHERE doc_type = 'memo' AND status = 'indexed' UNION ALL SELECT '2025', count(*) FILTER (year(created_at) = 2025) FROM documents WHERE doc_type = 'memo' AND status = 'indexed'")
def engine_compare(s, d):
    return _engine(s, d).run("how many memos in 2024 and 2025", TODAY)


@query(
    "SELECT period, 'pages' AS currency, round(sum(page_count), 2) AS value, count(*) AS documents FROM (SELECT 'Q' || quarter(created_at) || ' ' || year(created_at) AS period, page_count FROM documents"
    " WHERE doc_type = 'report' AND status = 'indexed' AND page_count IS NOT NULL AND year(created_at) = 2024 AND quarter(created_at) IN (1, 2)) GROUP BY period"
)
def engine_compare_amounts(s, d):
    return _engine(s, d).run("compare total amount of reports in q1 2024 vs q2 2024", TODAY)


@query("SELECT 'pages' AS currency, round(sum(page_count), 2) AS value, count(*) AS documents FROM documents WHERE status = 'indexed' AND page_count IS NOT NULL AND year(created_at) = 2024")
def engine_spend(s, d):
    return _engine(s, d).run("how much did we spend in 2024", TODAY)


@query("SELECT year(created_at)::VARCHAR AS key, count(*) AS count FROM documents WHERE doc_type = 'nda' AND status = 'indexed' GROUP BY 1")
def engine_group(s, d):
    return _engine(s, d).run("number of ndas by year", TODAY)


@query(f"{W} SELECT document_id, unit_id FROM w WHERE list_has_all(words, ['warehouse', 'employee']) AND {INDEXED}")
def engine_typo(s, d):
    """The question has a typing error in a word that no unit holds."""
    engine = _engine(s, d)
    return engine.candidates(engine.plan("warehuose employee", TODAY), ["fuzzy"]).where("match_type = 'fuzzy'").select("document_id", "unit_id").distinct()


@query(
    "SELECT DISTINCT document_id FROM entities WHERE type = 'organization'"
    f" AND trim(regexp_replace(regexp_replace(array_to_string({M.words_sql('value_norm')}, ' '), '\\b(?:{T.LEGAL_FORMS})\\b', ' ', 'g'), '\\s+', ' ', 'g')) = 'zenka ouvri services' AND {INDEXED}"
)
def engine_entity(s, d):
    """The question leaves the legal form out."""
    engine = _engine(s, d)
    return engine.candidates(engine.plan("contracts with Zenka Ouvri Services", TODAY), ["entity"]).select("document_id").distinct()


@query(f"{W}, p AS (SELECT DISTINCT document_id FROM w WHERE contains(' ' || array_to_string(words, ' ') || ' ', ' within thirty days ') AND {INDEXED}) SELECT document_id, 1 AS tier, 0.97::DOUBLE AS confidence, true AS proven FROM p")
def engine_phrase(s, d):
    """All documents with a quoted phrase, each with evidence that holds it."""
    found = _engine(s, d).run('"within thirty days"', TODAY, limit=1_000_000_000)
    held = F.exists("evidence", lambda e: F.concat_ws(" ", T.tokens(e["text"])).contains("within thirty days"))
    return found.select("document_id", "tier", "confidence", held.alias("proven"))


@query(f"{W} SELECT document_id, unit_id, CASE WHEN list_has_all(words, ['supplier', 'invoice', 'quarter']) THEN 1 ELSE 2 END AS tier FROM w WHERE list_has_all(words, ['supplier', 'invoice', 'quarter']) AND {INDEXED}")
def engine_all_terms(s, d):
    engine = _engine(s, d)
    found = engine.candidates(engine.plan("quarter supplier invoice", TODAY), ["lexical"]).where("match_type = 'all_terms'")
    exact = M.index(s, d).ranked(["supplier", "invoice", "quarter"]).select("unit_id")
    return found.join(exact, "unit_id", "left_semi").select("document_id", "unit_id", F.lit(1).alias("tier")).distinct()


@query(f"{W}, c AS (SELECT DISTINCT document_id FROM clauses WHERE clause_type = 'warranty' UNION SELECT document_id FROM w WHERE contains(' ' || array_to_string(words, ' ') || ' ', ' warrants to ') OR contains(' ' || array_to_string(words, ' ') || ' ', ' warranty ')) SELECT document_id FROM c WHERE {INDEXED}")
def engine_contextual(s, d):
    engine = _engine(s, d)
    return engine.candidates(engine.plan("what guarantee is given", TODAY), ["contextual"]).select("document_id").distinct()


@query("SELECT document_id, strftime(created_at, '%Y-%m-%d') AS value FROM documents WHERE status = 'indexed' AND filename = (SELECT min(filename) FROM documents WHERE status = 'indexed' AND filename LIKE 'lease_agreement_%')")
def engine_lookup(s, d):
    """The date of the document whose file name the question has as its words."""
    engine = _engine(s, d)
    name = M.documents(s, d).where("status = 'indexed' AND filename LIKE 'lease_agreement_%'").agg(F.min("filename")).first()[0]
    found = engine.run(f"what is the issue date of {name.rpartition('.')[0].replace('_', ' ')}", TODAY)
    return found.where("rank = 1").select("document_id", "value")
