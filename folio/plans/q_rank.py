"""Fusion, ranks, nearest neighbours and quality measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import rank as R
from folio.plans.registry import query
from folio.sources.tables import table

CANDIDATES_SQL = """
  c AS (SELECT document_id, 'exact' AS retriever, 'exact_term' AS match_type, 2 AS tier, 1 AS prio, confidence AS raw FROM clauses WHERE clause_type = 'payment'
        UNION ALL SELECT document_id, 'lexical', 'all_terms', 2, 2, confidence FROM clauses WHERE clause_type = 'termination'
        UNION ALL SELECT document_id, 'fuzzy', 'fuzzy', 3, 4, confidence FROM clauses WHERE clause_type = 'warranty'
        UNION ALL SELECT document_id, 'semantic', 'semantic', 4, 5, confidence FROM entities WHERE type = 'person')
"""
FUSED_SQL = f"""WITH {CANDIDATES_SQL},
  k AS (SELECT * FROM c WHERE match_type <> 'fuzzy' OR NOT EXISTS (SELECT 1 FROM c WHERE match_type NOT IN ('fuzzy', 'semantic'))),
  l AS (SELECT document_id, min(tier) AS tier, count(DISTINCT retriever) AS r, max(raw) FILTER (match_type = 'semantic') AS vec, min(row(tier, prio, -raw)) FILTER (match_type <> 'semantic') AS lex FROM k GROUP BY document_id),
  n AS (SELECT *, CASE WHEN lex IS NOT NULL THEN row_number() OVER (ORDER BY lex NULLS LAST, document_id) - 1 END AS lr, CASE WHEN vec IS NOT NULL THEN row_number() OVER (ORDER BY vec DESC NULLS LAST, document_id) - 1 END AS vr FROM l),
  s AS (SELECT document_id, tier, CASE WHEN tier = 1 THEN 1 WHEN tier = 2 OR coalesce(vec, 0) >= 0.45 THEN 2 ELSE 3 END AS key, round(coalesce(0.7 / (60 + lr), 0) + coalesce(1.0 / (60 + vr), 0) + 0.0015 * (r - 1), 9) AS score FROM n)
  SELECT document_id, tier, key, score, row_number() OVER (ORDER BY key, score DESC, document_id) AS rank FROM s"""


def _candidates(s, d):
    c = table(s, d, "clauses")
    parts = [
        c.where(F.col("clause_type") == kind).select("document_id", F.lit(retriever).alias("retriever"), F.lit(match).alias("match_type"), F.col("confidence").alias("raw_score"))
        for kind, retriever, match in (("payment", "exact", "exact_term"), ("termination", "lexical", "all_terms"), ("warranty", "fuzzy", "fuzzy"))
    ]
    meant = table(s, d, "entities").where("type = 'person'").select("document_id", F.lit("semantic").alias("retriever"), F.lit("semantic").alias("match_type"), F.col("confidence").alias("raw_score"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(meant)


@query(FUSED_SQL)
def rrf_fusion(s, d):
    return R.fuse(_candidates(s, d)).drop("vec")


@query(f"WITH {CANDIDATES_SQL} SELECT document_id, min(tier) AS tier, min(prio) AS priority FROM c GROUP BY document_id")
def tier_order(s, d):
    c = _candidates(s, d).select("document_id", R.tier(F.col("match_type")).alias("t"), R.priority(F.col("match_type")).alias("p"))
    return c.groupBy("document_id").agg(F.min("t").alias("tier"), F.min("p").alias("priority"))


@query(
    f"WITH f AS ({FUSED_SQL}), r AS (SELECT *, (hash_like * 37) % 101 AS relevance FROM (SELECT *, length(document_id) + rank AS hash_like FROM f)),"
    " n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank) AS slot, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN key <> 1 THEN -relevance END, rank) AS best FROM r)"
    " SELECT a.document_id, a.key, b.rank AS new_rank FROM n a JOIN n b ON a.key = b.key AND a.best = b.slot"
)
def rerank_groups(s, d):
    f = R.fuse(_candidates(s, d)).withColumn("relevance", ((F.length("document_id") + F.col("rank")) * 37) % 101)
    return R.rerank(f).select("document_id", "key", "new_rank")


@query(
    "WITH n AS (SELECT DISTINCT document_id AS question, lower(value) AS name FROM entities) SELECT question, name FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE a.question = b.question AND length(a.name) < length(b.name) AND contains(b.name, a.name))"
)
def longest_names(s, d):
    return R.longest_names(table(s, d, "entities").select(F.col("document_id").alias("question"), F.lower("value").alias("name")).distinct())


COSINE_SQL = """WITH q AS (SELECT vec_id AS query_id, embedding AS q, label AS asked FROM embeddings WHERE vec_id % 20 = 0),
  n AS (SELECT query_id, asked, vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 9) AS similarity FROM embeddings CROSS JOIN q),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM n QUALIFY rank <= 10)"""


def _asked(s, d):
    e = table(s, d, "embeddings")
    return e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def _nearest(s, d, k=10):
    return R.nearest(*_asked(s, d), k)


@query(f"{COSINE_SQL} SELECT query_id, vec_id, rank, round(similarity, 6) AS similarity FROM k")
def knn_top10(s, d):
    return _nearest(s, d).select("query_id", "vec_id", "rank", F.round("similarity", 6).alias("similarity"))


@query(f"{COSINE_SQL} SELECT query_id, vec_id FROM (SELECT *, max(similarity) OVER (PARTITION BY query_id) AS best FROM k) WHERE similarity >= greatest(0.3, best - 0.22)")
def semantic_margin(s, d):
    return R.within_margin(*_asked(s, d)).select("query_id", "vec_id")


@query(
    f"{COSINE_SQL}, g AS (SELECT query_id, vec_id AS item, 1 AS grade FROM embeddings JOIN q ON label = asked), h AS (SELECT query_id, rank, (asked = label) AS hit FROM k),"
    " r AS (SELECT query_id, count(*) AS relevant FROM g GROUP BY 1), i AS (SELECT query_id, (SELECT sum(1 / log2(x + 1)) FROM range(1, least(relevant, 10) + 1) t(x)) AS ideal, relevant FROM r)"
    " SELECT query_id, count(*) FILTER (rank <= 5 AND hit) / 5.0 AS precision_at_5, round(count(*) FILTER (hit) / any_value(relevant), 6) AS recall_at_k, round(coalesce(1.0 / min(rank) FILTER (hit), 0), 6) AS reciprocal_rank,"
    " round(sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) / any_value(ideal), 6) AS ndcg FROM h JOIN i USING (query_id) GROUP BY query_id"
)
def label_quality(s, d):
    e = table(s, d, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return R.label_quality(_nearest(s, d), asked, e)


@query(
    "WITH n AS (SELECT event_type AS kind, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events)"
    " SELECT kind, max(value) FILTER (n = ceil(0.5 * c)) AS p50, max(value) FILTER (n = ceil(0.95 * c)) AS p95, max(value) FILTER (n = ceil(0.99 * c)) AS p99 FROM n GROUP BY kind"
)
def latency_percentiles(s, d):
    return R.percentiles(table(s, d, "events").select(F.col("event_type").alias("kind"), "value"), "value")
