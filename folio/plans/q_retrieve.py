"""Retrievers, extraction, units and whole questions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import extract as X
from folio.functions import stem as St
from folio.functions import text as T
from folio.functions.chunks import chunk_pages
from folio.operators import postings as P
from folio.operators import retrieve as R
from folio.plans import model as M
from folio.plans.registry import query
from folio.sources.tables import table

W = f"WITH {M.UNITS_SQL}"


@query(
    f"{W}, {M.fold_sql('SELECT DISTINCT unnest(words) AS word FROM w')},"
    " j AS (SELECT unit_id, ' ' || string_agg(folded, ' ' ORDER BY pos) || ' ' AS t FROM (SELECT unit_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w) JOIN folds USING (word) GROUP BY unit_id)"
    " SELECT unit_id FROM j WHERE contains(t, ' ciosed fiie ') OR contains(t, ' oid cabinet ')"
)
def ocr_tolerant(s, d):
    index = M.index(s, d)
    return index.folded(["0ld", "cabinet"]).select("unit_id").union(index.folded(["c1osed", "file"]).select("unit_id")).distinct()


@query(f"{W} SELECT unit_id FROM w WHERE len(list_filter(words, lambda x: starts_with(x, '8012') OR ends_with(x, '8012'))) > 0")
def partial_identifier(s, d):
    return M.index(s, d).part("8012").select("unit_id")


@query(
    f"WITH f AS (SELECT document_id, {M.words_sql("replace(filename, '_', ' ')")} AS w FROM documents)"
    " SELECT document_id, CASE WHEN contains(array_to_string(w, ' '), 'policy branch') THEN 'filename' ELSE 'filename_terms' END AS match_type FROM f WHERE contains(array_to_string(w, ' '), 'policy branch') OR list_has_all(w, ['policy', 'branch'])"
)
def filename_match(s, d):
    return R.filename(M.documents(s, d), ["policy", "branch"]).select("document_id", "match_type")


@query(f"SELECT DISTINCT document_id, length('andrew tuvglinesibcald') AS score FROM entities WHERE type IN ('person', 'organization', 'jurisdiction') AND array_to_string({M.words_sql('value_norm')}, ' ') = 'andrew tuvglinesibcald'")
def entity_documents(s, d):
    found = R.entity(s, table(s, d, "entities"), "contracts with Andrew Tuvglinesibcald")
    return found.select("document_id", F.col("raw_score").cast("int").alias("score"))


@query(
    f"{W}, c AS (SELECT document_id, CAST(NULL AS VARCHAR) AS unit_id, 'concept_clause' AS match_type FROM clauses WHERE clause_type = 'warranty'"
    " UNION ALL SELECT document_id, unit_id, 'concept' FROM w WHERE contains(' ' || array_to_string(words, ' ') || ' ', ' warrants to ') UNION ALL SELECT document_id, unit_id, 'concept' FROM w WHERE contains(' ' || array_to_string(words, ' ') || ' ', ' warranty '))"
    " SELECT document_id, match_type, count(*) AS n FROM c GROUP BY ALL"
)
def contextual_concepts(s, d):
    return R.contextual(M.units(s, d), table(s, d, "clauses"), "what guarantee is given").groupBy("document_id", "match_type").agg(F.count("*").alias("n"))


@query(f"{W} SELECT w.unit_id FROM w JOIN u USING (unit_id) WHERE u.unit_type = 'document' AND list_has_all(words, ['letter', 'landlord'])")
def metadata_units(s, d):
    return R.metadata(M.units(s, d), ["letter", "landlord"]).select("unit_id")


@query(f"{W} SELECT a.word FROM (VALUES ('supplier'), ('zeppelin'), ('invoice'), ('quasar')) a(word) WHERE NOT EXISTS (SELECT 1 FROM w WHERE list_contains(words, a.word))")
def unmatched_terms(s, d):
    return R.unmatched(M.units(s, d), ["supplier", "zeppelin", "invoice", "quasar"])


@query()
def stem_df(s, d):
    return M.index(s, d).terms("s").withColumnRenamed("term", "stem")


@query()
def all_stems(s, d):
    return M.index(s, d).ranked(sorted({St.stem(w) for w in ("suppliers", "invoicing", "quarters")}), kind="s").drop("matched")


@query(f"{W} SELECT document_id, unit_id, tf FROM (SELECT document_id, unit_id, count(*) AS tf FROM (SELECT document_id, unit_id, unnest(words) AS t FROM w) WHERE t IN ('invoice', 'invoices', 'invoiced', 'invoicing') GROUP BY ALL)")
def stem_postings(s, d):
    """One stem, whose words are few and known."""
    return M.index(s, d).postings("s", [St.stem("invoices")]).select("document_id", "unit_id", "tf")


@query(f"{W} SELECT document_id, 'n' AS kind, t AS term, count(*) AS tf FROM (SELECT document_id, unnest({M.words_sql("replace(filename, '_', ' ')")}) AS t FROM documents) GROUP BY ALL")
def filename_postings(s, d):
    return M.index(s, d).postings("n").select("document_id", F.lit("n").alias("kind"), "term", "tf")


LEGAL = T.LEGAL_FORMS


@query(
    f"WITH n AS (SELECT DISTINCT value, concat_ws(' ', array_to_string({M.words_sql('value')}, ' '), nullif(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(value, '\\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\\b', 1), lambda x: lower(regexp_replace(x, '([a-z])([A-Z])', '\\1 \\2', 'g'))))), ' '), '')) AS name FROM entities WHERE type = 'organization')"
    f" SELECT value, coalesce(nullif(trim(regexp_replace(regexp_replace(name, '\\b(?:{LEGAL})\\b', ' ', 'g'), '\\s+', ' ', 'g')), ''), name) AS name FROM n"
)
def organization_names(s, d):
    named = table(s, d, "entities").where("type = 'organization'").select("value").distinct()
    return named.select("value", T.norm_org(F.col("value")).alias("name"))


def _pages(s, d):
    return table(s, d, "pages").select("document_id", "page", "text").distinct()


def _with_written(s, d, kinds: tuple[str, ...]):
    """Facts of some kinds with the text of their span."""
    pages = _pages(s, d)
    facts = X.analyze(pages, kinds)
    return facts.join(pages, ["document_id", "page"]).withColumn("written", F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))).drop("text")


@query()
def extracted_facts(s, d):
    return X.analyze(_pages(s, d))


@query("SELECT * FROM (VALUES ('clause', true), ('identifier', true), ('organization', true), ('person', true), ('relation', true)) t(kind, exact)")
def fact_spans(s, d):
    """Facts that are quoted stand where their span says."""
    return _with_written(s, d, ("identifier", "person", "organization", "clause", "relation")).groupBy("kind").agg(F.every(F.col("written") == F.col("value")).alias("exact"))


@query()
def page_units(s, d):
    return chunk_pages(_pages(s, d))


@query("SELECT document_id, page, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS covered FROM (SELECT DISTINCT document_id, page, text FROM pages) WHERE NOT contains(text, ' | ') AND regexp_matches(text, '[\\p{L}\\p{N}]')")
def page_unit_cover(s, d):
    """Letters and digits of the pages without tables that stand in a unit, each once: all of them."""
    units = chunk_pages(_pages(s, d).where(~F.col("text").contains(" | ")))
    before = F.lag("char_end", 1, 0).over(Window.partitionBy("document_id", "page").orderBy("ordinal"))
    new = units.withColumn("from", F.greatest(F.lit(0), before - F.col("char_start")))
    kept = F.regexp_replace(F.substring("text", F.col("from") + 1, F.length("text")), r"[^\p{L}\p{N}]", "")
    return new.groupBy("document_id", "page").agg(F.sum(F.length(kept)).alias("covered")).where("covered > 0")


@query("SELECT document_id, page, day FROM (SELECT document_id, page, unnest(regexp_extract_all(text, '\\b\\d{4}-\\d{2}-\\d{2}\\b')) AS day FROM (SELECT DISTINCT document_id, page, text FROM pages)) WHERE try_cast(day AS DATE) IS NOT NULL")
def iso_dates(s, d):
    return _with_written(s, d, ("date",)).where(F.col("written").rlike(r"^\d{4}-\d{2}-\d{2}$")).select("document_id", "page", F.col("value").alias("day"))


@query("SELECT document_id, page, regexp_extract(a, '^[A-Z]+') AS currency, CAST(replace(regexp_extract(a, '[0-9,.]+$'), ',', '') AS DOUBLE) AS value FROM (SELECT document_id, page, unnest(regexp_extract_all(text, '\\b(?:EUR|USD|GBP|CHF) \\d[\\d,]*\\.\\d{2}')) AS a FROM (SELECT DISTINCT document_id, page, text FROM pages))")
def page_amounts(s, d):
    found = _with_written(s, d, ("amount",)).where(F.col("written").rlike(r"^(?:EUR|USD|GBP|CHF) \d[\d,]*\.\d{2}$"))
    return found.select("document_id", "page", F.col("unit").alias("currency"), F.col("value").cast("double").alias("value"))


@query("SELECT count(*) AS rows, count(*) FILTER (substring(p.text, c.char_start + 1, c.char_end - c.char_start) = c.text) AS exact FROM (SELECT DISTINCT document_id, page, char_start, char_end, text FROM clauses) c JOIN (SELECT DISTINCT document_id, page, text FROM pages) p USING (document_id, page)")
def clause_spans(s, d):
    c = table(s, d, "clauses").select("document_id", "page", "char_start", "char_end", F.col("text").alias("clause")).distinct()
    both = c.join(table(s, d, "pages").select("document_id", "page", "text").distinct(), ["document_id", "page"])
    return both.agg(F.count("*").alias("rows"), F.count_if(F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("clause")).alias("exact"))
