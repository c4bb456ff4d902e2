"""Whole results: cases that a cut would lose."""

from datetime import datetime

from folio.functions import extract as X
from folio.functions.chunks import page_units
from folio.operators.engine import Engine, TenantCatalog
from folio.operators.postings import corrections
from folio.plans import registry


def test_margin_has_no_limit(spark, tmp_path):
    rows = [(i, "a", [1.0, i / 1000.0]) for i in range(31)] + [(100 + i, "b", [-1.0, 0.1]) for i in range(1, 5)]
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {(r["query_id"], r["vec_id"]) for r in registry.queries()["semantic_margin"](spark, str(tmp_path)).collect()}
    assert found == {(q, v) for q in (0, 20) for v in range(31)}


def test_engine_runs_the_retrievers_of_the_plan(spark, tmp_path):
    texts = {
        "d1": "the 0ld cabinet was moved", "d2": "order INV-77-0048123 was paid", "d3": "nothing here", "d4": "the suppliers invoiced us", "d5": "a letter", "d6": "some clause",
    }
    names = {"d3": "harbour_survey.txt"}
    at = datetime(2026, 1, 1)
    docs = [("t", d, names.get(d, f"{d}x.txt"), d, "memo", "indexed", "en", "text", "txt", False) for d in texts]
    spark.createDataFrame(docs, "tenant_id string, document_id string, filename string, title string, doc_type string, status string, language string, kind string, file_ext string, has_signature boolean").write.parquet(f"{tmp_path}/documents.parquet")
    units = [("t", d, f"{d}:0", 1, "passage", text, 0, at) for d, text in texts.items()] + [("t", "d5", "d5:1", 1, "document", "title quarterly ledger", None, at)]
    spark.createDataFrame(units, "tenant_id string, document_id string, unit_id string, page int, unit_type string, text string, char_start int, stored_at timestamp").write.parquet(f"{tmp_path}/units.parquet")
    spark.createDataFrame([("t", "d5", "person", "Ann Marlowe", "ann marlowe")], "tenant_id string, document_id string, type string, value string, value_norm string").write.parquet(f"{tmp_path}/entities.parquet")
    spark.createDataFrame([("t", "d6", "warranty")], "tenant_id string, document_id string, clause_type string").write.parquet(f"{tmp_path}/clauses.parquet")
    engine = Engine(TenantCatalog(spark, str(tmp_path), "t"))
    for question, document, kind in (
        ("old cabinet", "d1", "ocr_tolerant"), ("0048123", "d2", "partial_identifier"), ("harbour survey", "d3", "filename"), ("supplier invoicing", "d4", "all_terms"), ("ann marlowe", "d5", "entity"),
        ("guarantee", "d6", "concept_clause"), ("quarterly ledger", "d5", "metadata"), ("suplliers invoiced", "d4", "fuzzy"),
    ):
        found = {(r["document_id"], r["match_type"]) for r in engine.candidates(engine.plan(question, at.date())).collect()}
        assert (document, kind) in found, question
    for question, n in (("how many documents about old cabinet", 1), ("how many documents about harbour survey", 1), ("how many documents about supplier invoicing", 1), ("how many documents about suplliers invoiced", 0)):
        plan = engine.plan(question, at.date())
        plan.text = question.split("about ")[1]
        assert engine.document_set(plan).count() == n, question


def test_units_and_facts_are_whole():
    rows = [f"r{i} | {i}" for i in range(5200)]
    assert [u[1] for u in page_units("h | v\n" + "\n".join(rows))] == rows
    body = "The parties agree on this. " * 80 + "The premium of the insurance is paid by the tenant."
    clause = X.find_clauses(f"1. General matters\n{body}")
    assert [c["name"] for c in clause] == ["insurance"] and clause[0]["value"].endswith("by the tenant.")
    assert X.find_relations("Remark: " + "v" * 400)[0]["value"] == "v" * 400
    text = "we met. This deed is governed by\nthe laws of Spain. Either side may terminate this lease early. Nothing more.\nGoverning law: Italy"
    stated = X.find_clauses(text)
    assert [(c["name"], c["value"]) for c in stated] == [
        ("governing_law", "This deed is governed by\nthe laws of Spain."), ("termination", "Either side may terminate this lease early."), ("governing_law", "Governing law: Italy"),
    ]
    assert all(text[c["start"] : c["end"]] == c["value"] for c in stated)


def test_corrections_without_a_shortlist(spark):
    asked = "warehouses"  # words with all of its trigrams but one or two are more alike than the nearest one, a swap
    far = [f"warehouses{a}{b}"[:12] for a in "abcdefgh" for b in "stuvwxyz"]
    terms = spark.createDataFrame([(t,) for t in {*far, "waerhouses"}], "term string")
    assert [(r["term"], r["distance"]) for r in corrections(terms, asked).collect()] == [("waerhouses", 1)]
