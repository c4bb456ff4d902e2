"""Plugged parts: embedder, vector store, scorer, retrievers; relations and the audit."""

from pyspark.sql import functions as F

from folio.functions import extract as X
from folio.operators import meaning as N
from folio.operators.engine import CANDIDATE
from folio.sources import sinks as S


def test_store(spark, tmp_path):
    embedder = N.HashEmbedder(64)
    texts = {"u1": "the monthly rent of the office", "u2": "forklifts in the warehouse", "u3": "rents for offices each month"}
    rows = spark.createDataFrame([(u, f"d{u[1]}", t) for u, t in texts.items()] + [("u4", "d4", None)], "unit_id string, document_id string, text string")
    store = N.VectorStore(spark, str(tmp_path / "v"))
    assert store.vectors().count() == 0
    store.upsert(N.embedded(rows, embedder))
    assert store.vectors().count() == 4
    found = {r["unit_id"] for r in store.search(embedder.embed(["monthly office rent"])[0]).collect()}
    assert "u1" in found and "u2" not in found
    store.upsert(N.embedded(rows.where("unit_id = 'u1'").withColumn("unit_id", F.lit("u9")), embedder))
    store.delete(spark.createDataFrame([("d2",)], "document_id string"))
    assert {r["unit_id"] for r in store.vectors().collect()} == {"u9", "u3", "u4"}


def test_engine_with_plugged_parts(spark, engine, tmp_path):
    embedder = N.HashEmbedder(128)
    store = N.VectorStore(spark, str(tmp_path / "v"))
    store.upsert(N.embedded(engine.catalog.index().units().select("unit_id", "document_id", "text"), embedder))

    class Fixed:
        name = "house list"

        def retrieve(self, engine, plan):
            return spark.createDataFrame([("d3", "d3:0", "house list", "relation", 1.0, "", None, None, None), ("x1", "x1:0", "house list", "relation", 1.0, "", None, None, None)], CANDIDATE)

    own = type(engine)(engine.catalog, engine.fields, (N.Semantic(store, embedder), Fixed()), N.overlap)
    plan = own.plan("the monthly rent of the harbour office that may be renewed")
    found = {(r["document_id"], r["retriever"]) for r in own.candidates(plan).collect()}
    assert ("d1", "semantic") in found and ("d3", "house list") in found and not any(d == "x1" for d, _ in found)
    assert own.run("the monthly rent of the harbour office that may be renewed").collect()[0]["document_id"] == "d1"


def test_rerank_moves_inside_a_tier_only(spark):
    rows = [(1, "a", 1, "x"), (2, "b", 2, "nothing"), (3, "c", 2, "rent of the office"), (4, "d", 3, "rent of the office"), (50, "e", 2, "rent of the office")]
    found = N.reranked(spark.createDataFrame(rows, "rank int, document_id string, tier int, snippet string"), "office rent", N.overlap)
    assert [(r["document_id"], r["rank"]) for r in found.collect()] == [("a", 1), ("c", 2), ("b", 3), ("d", 4), ("e", 50)]


def test_relations(spark):
    text = "We met. Lumen Ltd supplies Harrow Inc with steel until 2027. Done."
    (r,) = X.pattern_relations(text, {"supplies": r"(?P<subject>\w+ Ltd) supplies (?P<object>\w+ Inc)(?: with (?P<goods>\w+))?"})
    assert (r["subject"], r["object"], r["qualifiers"]) == ("Lumen Ltd", "Harrow Inc", {"goods": "steel"}) and text[r["start"] : r["end"]].startswith("Lumen")


def test_audit(spark, tmp_path):
    for n in range(2):
        S.append_audit(spark, str(tmp_path / "a"), "ann", "delete", f"d{n}", {"why": "asked"})
    rows = spark.read.parquet(str(tmp_path / "a")).orderBy("target").collect()
    assert [(r["actor"], r["target"], r["detail"]) for r in rows] == [("ann", "d0", '{"why": "asked"}'), ("ann", "d1", '{"why": "asked"}')]
