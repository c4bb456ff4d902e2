"""The engine over a small collection of one tenant, with its index."""

import unicodedata
from datetime import date

import pytest
from conftest import TEXTS
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import answers as A
from folio.operators import compute as C
from folio.operators import rank as R
from folio.plans.packs import Domain

TODAY = date(2026, 1, 1)


def test_evidence_is_proven_and_quoted(engine):
    found = engine.run('"within thirty days"', TODAY).collect()
    assert {r["document_id"] for r in found} == {"d2", "d4"}
    for r in found:
        assert r["tier"] == 1 and r["confidence"] == 0.97
        for e in r["evidence"]:
            assert TEXTS[r["document_id"]][e["char_start"] : e["char_end"]] == e["text"] and "thirty" in e["text"]
    summary = engine.run("quarterly ledger", TODAY).collect()[0]
    assert summary["document_id"] == "d3" and summary["snippet"].startswith("There are 14")
    clause = engine.run("secrecy", TODAY).collect()
    assert [r["document_id"] for r in clause] == ["d4"] and clause[0]["evidence"][0]["match_type"] == "concept_clause"


def test_evidence_that_cannot_be_proven_drops_the_document(engine, spark):
    plan = engine.plan('"within thirty days"', TODAY)
    wrong = engine.candidates(plan).withColumn("unit_id", F.lit("d3:0")).withColumn("document_id", F.lit("d3"))
    assert engine.evidence(plan, wrong).count() == 0
    engine.candidates, kept = lambda p, s=None: wrong, engine.candidates
    try:
        assert engine.search(plan).count() == 0
    finally:
        engine.candidates = kept


def test_lookup_fact_comparison(engine):
    assert [(r["document_id"], r["value"]) for r in engine.run("when does the harbour office lease expire", TODAY).collect()] == [("d1", "2027-05-03")]
    assert engine.answer("how many forklifts are in the warehouse", TODAY)["rows"][0]["value"] == "14"
    rows = {(r["period"], r["currency"], r["value"]) for r in engine.run("compare total amount in 2023 and 2024", TODAY).collect()}
    assert rows == {("2023", "EUR", 50.0), ("2024", "EUR", 1200.0)}
    assert engine.run("how much did we spend with lumen harrow", TODAY).collect()[0]["value"] == 1200.0
    assert engine.plan("how much did we spend with lumen harrow", TODAY).filters.parties == ["lumen harrow"]


def test_routing(engine):
    assert engine.answer("how many documents", TODAY) == {"provider": "computation", "status": "computed", "rows": [{"value": 4}]}
    said = engine.answer("what is the monthly rent of the office", TODAY)
    assert said["provider"] == "extractive" and said["sentences"][0]["text"] == "The monthly rent is 900 EUR."
    model = lambda q, items: [{"text": "The monthly rent is 900 EUR.", "citations": ["E1"]}, {"text": "The rent is 901 EUR.", "citations": ["E1"]}]
    told = engine.answer("what is the monthly rent of the office", TODAY, model)
    assert [s["text"] for s in told["sentences"]] == ["The monthly rent is 900 EUR."] and told["dropped"][0][1] == "number"
    assert engine.answer("what about zeppelins", TODAY)["status"] == "abstained"


def test_scores_are_those_of_the_tenant_whatever_the_filter(engine):
    def score(question):
        rows = engine.candidates(engine.plan(question, TODAY), ["lexical"]).where("document_id = 'd4' AND match_type = 'all_terms'").collect()
        return rows[0]["raw_score"]

    assert score("supplier confidence") == score("supplier confidence nda")


def test_only_asked_terms_are_read(engine):
    index = engine.catalog.index()
    plan = index.ranked(["supplier", "keeps"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan and "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "In(term" in plan
    asked = engine.catalog.spark.createDataFrame([(1, ["supplier", "keeps"]), (2, ["forklifts"]), (3, ["nothing"])], "question_id int, terms array<string>")
    assert {(r["question_id"], r["document_id"]) for r in index.ranked_batch(asked).collect()} == {(1, "d4"), (2, "d3")}
    assert index.unknown(["supplier", "suppliers", "zeppelin"]) == ["zeppelin"]


def test_fusion_rules(spark):
    rows = [("a", "e", "exact_phrase", 1.0), ("b", "s", "semantic", 0.4), ("c", "c", "concept", 0.5), ("d", "x", "all_terms", 1.0), ("f", "s", "semantic", 0.9)]
    found = spark.createDataFrame(rows, "document_id string, retriever string, match_type string, raw_score double")
    kept = lambda **k: {r["document_id"] for r in R.fuse(found, **k).collect()}
    assert kept(identifiers_only=True) == {"a", "c", "d"} and kept(phrased=True) == {"a"} and kept(unmatched=True) == {"a", "d", "f"}
    soft = spark.createDataFrame([("d",)], "document_id string")
    scores = [{r["document_id"]: r["score"] for r in R.fuse(found, soft=s).collect()} for s in (None, soft)]
    assert scores[1]["d"] - scores[0]["d"] == pytest.approx(0.006) and scores[1]["a"] == scores[0]["a"]


def test_helpers(spark):
    df = spark.createDataFrame([("b0ok a11 c1ose 0ld 80x m0d5k ab12 vvarn",), ("The Lumen-Harrow Co. Ltd.",), ("Limited",)], "t string")
    folded = [r[0] for r in df.select(F.array_join(T.fold(T.tokens(F.col("t"))), " ")).collect()]
    assert folded[0].split() == T.folded_words("b0ok a11 c1ose 0ld 80x m0d5k ab12 vvarn".split()) == ["book", "a11", "ciose", "oid", "80x", "modsk", "ab12", "wam"]
    assert [r[0] for r in df.select(T.norm_org(F.col("t"))).collect()][1:] == ["lumen harrow", "limited"]
    assert T.highlight_terms(["a b"], "find INV-77/2 now") == ["a b", "find inv 77 2 now", "find", "inv", "77", "now", "INV-77/2"]
    assert A.counted_noun("how many forklifts are there") == "forklifts"
    labels = [C.period_label(*map(date.fromisoformat, x)) for x in (("2024-01-01", "2024-12-31"), ("2024-04-01", "2024-06-30"), ("2024-02-01", "2024-02-29"), ("2024-02-03", "2024-02-03"), ("2024-02-03", "2024-03-01"))]
    assert labels == ["2024", "Q2 2024", "2024-02", "2024-02-03", "2024-02-03 to 2024-03-01"]


def test_tokens_equal_those_of_a_question(spark):
    texts = ["Straße GROẞ ﬁle Ｗｏｒｄ m² ΟΔΟΣ ½ ǅ №5 foo_bar İstanbul", "naïve Café x", "ﬃ ŉ ĳs Ⅷ ㎏"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.tokens(F.col("t")).alias("w")).collect()
    assert rows[0]["w"][:7] == ["strasse", "gross", "file", "word", "m2", "οδοσ", "1"]
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text IS NOT NULL").select("text", T.tokens(F.col("text")).alias("w")).collect()
    other = [r for r in documents if r["w"] != T.split_words(r["text"])]
    assert all(any(unicodedata.combining(c) or unicodedata.category(c) == "Cf" for c in r["text"]) for r in other)  # separate accents, invisible signs


def test_domain_of_packs(engine):
    own = type(engine)(engine.catalog, domain=Domain(types={"warehouse_receipt": {}}, concepts={"confidentiality": ("hush hush",)}))
    plan = own.plan("how many warehouse receipts", TODAY)
    assert plan.filters.doc_types == ["warehouse_receipt"] and plan.filters.hard and plan.text == ""
    found = {(r["document_id"], r["match_type"]) for r in own.candidates(own.plan("is it hush hush", TODAY), ["contextual"]).collect()}
    assert ("d4", "concept_clause") in found
