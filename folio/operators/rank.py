"""Ranking: fusion of retrievers, ranks, reranking, nearest neighbours and evaluation measures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.durable import materialize, with_rank

# Match type -> (tier, priority inside the tier), retrieval constants.
MATCHES = {
    "exact_phrase": (1, 0), "exact_identifier": (1, 0), "filename": (1, 0), "structured": (1, 0), "exact_term": (2, 1), "joined_form": (2, 1), "metadata": (2, 1), "entity": (2, 1),
    "relation": (2, 1), "concept_clause": (2, 1), "partial_identifier": (2, 2), "all_terms": (2, 2), "concept": (2, 2), "filename_terms": (2, 2), "ocr_tolerant": (3, 3), "most_terms": (3, 3),
    "fuzzy": (3, 4), "semantic": (4, 5),
}
PHRASE_EVIDENCE = ("exact_phrase", "exact_identifier", "ocr_tolerant", "fuzzy", "filename")
CONCEPTUAL = ("concept", "concept_clause", "relation", "semantic")
RRF_K, PER_RETRIEVER, SOFT_TYPE = 60, 0.0015, 0.006
FLOOR, MARGIN, STRONG = 0.30, 0.22, 0.15
#: Candidates that one task may put in order.
FEW = 100_000
#: Queries of a block that are compared with a batch at once (bounds the memory of a task).
PART = 256


def _mapped(column: Column, k: int) -> Column:
    return F.create_map(*[F.lit(x) for name, v in MATCHES.items() for x in (name, v[k])])[column]


def tier(match_type: Column) -> Column:
    return _mapped(match_type, 0)


def priority(match_type: Column) -> Column:
    return _mapped(match_type, 1)


def fuse(
    candidates: DataFrame, exact_intent: bool = False, partition: str | None = None, *, identifiers_only: bool = False, phrased: bool = False, unmatched: bool = False, soft: DataFrame | None = None, few: bool = False
) -> DataFrame:
    """document_id, score, key, rank from candidates (document_id, retriever, match_type, raw_score).

    Fuzzy hits go when any other lexical one exists; lexical and semantic ranks are added by
    reciprocal rank; further retrievers lift a little; results are ordered by key, then score, then id.
    identifiers_only: the question is identifiers alone, so documents alike in meaning only are dropped. phrased:
    it holds a quoted phrase, so only documents with PHRASE_EVIDENCE stay. unmatched: it uses words that no
    document has, so documents that match by CONCEPTUAL evidence only must be strongly similar. soft:
    document_id of those of a type that the question mentions; they are lifted a little. few: the candidates
    have been counted and are at most FEW, so one task may number them.
    """
    by = [partition] if partition else []
    lexical = F.col("match_type") != "semantic"
    other = F.max((lexical & (F.col("match_type") != "fuzzy")).cast("int"))
    if by:
        c = candidates.withColumn("_other", other.over(Window.partitionBy(*by)))
    else:
        c = candidates.crossJoin(F.broadcast(candidates.agg(other.alias("_other"))))  # one row
    c = c.where("NOT (match_type = 'fuzzy' AND coalesce(_other, 0) = 1)")
    c = c.withColumn("_tier", tier(F.col("match_type"))).withColumn("_first", F.struct("_tier", priority(F.col("match_type")).alias("p"), (-F.col("raw_score")).alias("s")))
    docs = c.groupBy(*by, "document_id").agg(
        F.min(F.when(lexical, F.col("_first"))).alias("lex"), F.max(F.when(~lexical, F.col("raw_score"))).alias("vec"), F.count_distinct("retriever").alias("retrievers"), F.min("_tier").alias("tier"),
        F.max(F.col("match_type").isin(*PHRASE_EVIDENCE)).alias("_phrase"), F.max(~F.col("match_type").isin(*CONCEPTUAL)).alias("_said"),
    )

    def numbered(df: DataFrame, name: str, *order) -> DataFrame:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))) if by or few else with_rank(df, name, *order)

    docs = numbered(numbered(docs, "_l", F.asc_nulls_last("lex"), F.asc("document_id")), "_v", F.desc_nulls_last("vec"), F.asc("document_id"))
    docs = docs.withColumn("lex_rank", F.when(F.col("lex").isNotNull(), F.col("_l") - 1)).withColumn("vec_rank", F.when(F.col("vec").isNotNull(), F.col("_v") - 1))
    w_lex, w_vec = (1.0, 0.6) if exact_intent else (0.7, 1.0)
    if identifiers_only:
        docs = docs.where(F.col("lex").isNotNull())
    elif phrased:
        docs = docs.where("_phrase")
    if unmatched:
        docs = docs.where(F.col("_said") | (F.coalesce("vec", F.lit(0.0)) >= FLOOR + STRONG))
    score = F.coalesce(w_lex / (RRF_K + F.col("lex_rank")), F.lit(0.0)) + F.coalesce(w_vec / (RRF_K + F.col("vec_rank")), F.lit(0.0)) + PER_RETRIEVER * (F.col("retrievers") - 1)
    if soft is not None:
        docs = docs.join(soft.select("document_id", F.lit(True).alias("_soft")).distinct(), "document_id", "left")
        score = score + F.when(F.col("_soft"), SOFT_TYPE).otherwise(0.0)
    exact = F.lit(exact_intent) | (F.col("tier") == 1)
    key = F.when(exact, F.col("tier")).when((F.col("tier") == 2) | (F.coalesce("vec", F.lit(0.0)) >= FLOOR + STRONG), 2).otherwise(3)
    docs = docs.withColumn("score", F.round(score, 9)).withColumn("key", key)
    return numbered(docs.select(*by, "document_id", "tier", "key", "score", "vec"), "rank", F.asc("key"), F.desc("score"), F.asc("document_id"))


def rerank(ranked: DataFrame, groups: str = "key", frozen: int = 1) -> DataFrame:
    """Reorder by ``relevance`` inside each group; slots stay with the group, the frozen group stays as it is.

    Rows are numbered over range partitions, so a group is not brought into one task.
    """
    best = F.when(F.col(groups) != frozen, -F.col("relevance"))
    both = with_rank(with_rank(ranked, "_slot", F.asc(groups), F.asc("rank")), "_best", F.asc(groups), best.asc(), F.asc("rank"))
    numbered = materialize(both)
    return numbered.join(numbered.select(F.col("_slot").alias("_best"), F.col("rank").alias("new_rank")), "_best").drop("_slot", "_best")


def longest_names(found: DataFrame) -> DataFrame:
    """Names of a question without those that another found name of it contains (question, name)."""
    other = found.select("question", F.col("name").alias("longer"))
    contained = (found["question"] == other["question"]) & (F.length("name") < F.length("longer")) & F.col("longer").contains(F.col("name"))
    return found.join(other, contained, "left_anti")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _searched(vectors: DataFrame, queries: DataFrame, keep: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], block: int) -> DataFrame:
    """query_id, vec_id, label, similarity of the pairs that ``keep`` picks of each batch of vectors.

    Queries (query_id, q) come in blocks of fixed size, each sent to all tasks in turn. A task
    multiplies its batches of vectors with the block, PART queries at a time. keep(similarities, vec_ids)
    gives the places of queries and vectors. Vectors without length have no similarity and no row.
    """
    spark, parts, ids, held = vectors.sparkSession, [], [], []
    id_type, vec_type, label_type = queries.schema["query_id"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString(), vectors.schema["label"].dataType.simpleString()
    schema = f"query_id {id_type}, vec_id {vec_type}, label {label_type}, similarity double"

    def search() -> None:
        matrix = np.array(held, np.float64)
        length = np.linalg.norm(matrix, axis=1, keepdims=True)
        sent = spark.sparkContext.broadcast((np.array(ids), np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, asked = sent.value
            for batch in batches:
                column = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                norm = np.linalg.norm(column, axis=1)
                rows = np.nonzero(norm > 0)[0]
                if not len(rows):
                    continue
                vec_ids = batch.column(0).to_numpy(zero_copy_only=False)[rows]
                for at in range(0, len(names), PART):
                    alike = np.round((asked[at : at + PART] @ column[rows].T) / norm[rows], 9)
                    one, other = keep(alike, vec_ids)
                    some = pa.array(rows[other])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[at + one]), batch.column(0).take(some), batch.column(1).take(some), pa.array(alike[one, other])], ["query_id", "vec_id", "label", "similarity"]
                    )

        parts.append(vectors.select("vec_id", "label", "embedding").where("embedding IS NOT NULL").mapInArrow(best, schema))

    for row in queries.where("q IS NOT NULL").toLocalIterator():
        ids.append(row["query_id"])
        held.append(row["q"])
        if len(ids) == block:
            search()
            ids, held = [], []
    if ids:
        search()
    found = spark.createDataFrame([], schema)
    for part in parts:
        found = found.unionByName(part)
    return found


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096) -> DataFrame:
    """query_id, vec_id, label, similarity, rank: exact top k by cosine for a stated query set (query_id, q).

    A task keeps the best k of each query and batch, so what is shuffled is k rows a query and batch.
    """

    def top(alike: np.ndarray, vec_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((np.broadcast_to(vec_ids, alike.shape), -alike), axis=1)[:, :k]
        return np.repeat(np.arange(len(order)), order.shape[1]), order.ravel()

    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return _searched(vectors, queries, top, block).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def within_margin(vectors: DataFrame, queries: DataFrame, floor: float = FLOOR, margin: float = MARGIN, block: int = 4096) -> DataFrame:
    """query_id, vec_id, label, similarity: all neighbours that ``semantic`` keeps, however many.

    A task drops what is too far from the best of its own batch; the best of all is no less similar,
    so nothing is lost by that.
    """

    def close(alike: np.ndarray, vec_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(alike >= np.maximum(floor, alike.max(axis=1, keepdims=True) - margin))

    return semantic(_searched(vectors, queries, close, block), floor, margin)


def semantic(found: DataFrame, floor: float = FLOOR, margin: float = MARGIN) -> DataFrame:
    """Neighbours that are similar enough, and not much less so than the query's best one."""
    best = F.max("similarity").over(Window.partitionBy("query_id"))
    return found.withColumn("_best", best).where(F.col("similarity") >= F.greatest(F.lit(floor), F.col("_best") - margin)).drop("_best")


def quality(ranked: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """precision_at_5, recall_at_k, reciprocal rank and nDCG@k for each query.

    ranked: query_id, item, rank; grades: query_id, item, grade (1 and more are relevant).
    """
    hits = ranked.join(grades, ["query_id", "item"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    got = hits.groupBy("query_id").agg(
        (F.count_if((F.col("rank") <= 5) & (F.col("grade") > 0)) / 5).alias("precision_at_5"),
        F.count_if((F.col("rank") <= k) & (F.col("grade") > 0)).alias("found"),
        F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias("dcg"),
    )
    ideal = grades.where("grade > 0").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "item")))
    best = ideal.groupBy("query_id").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("place") <= k, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("ideal"))
    out = got.join(best, "query_id", "left")
    return out.select(
        "query_id", "precision_at_5", F.round(F.coalesce(F.try_divide("found", "relevant"), F.lit(0.0)), 6).alias("recall_at_k"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0)), 6).alias("ndcg"),
    )


def label_quality(ranked: DataFrame, asked: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """quality() where an item is relevant if its label is the query's.

    ranked: query_id, label (of the item), rank; asked: query_id, label; items: label, one row an item. What is
    relevant is counted by label, so no query meets all items of its label.
    """
    counts = items.groupBy("label").agg(F.count("*").alias("relevant"))
    wanted = asked.join(counts, "label", "left").withColumnRenamed("label", "asked")
    hits = ranked.join(wanted, "query_id").withColumn("hit", F.col("label").eqNullSafe(F.col("asked")) & F.col("asked").isNotNull())
    got = hits.groupBy("query_id", "relevant").agg(
        (F.count_if((F.col("rank") <= 5) & F.col("hit")) / 5).alias("precision_at_5"),
        F.count_if((F.col("rank") <= k) & F.col("hit")).alias("found"),
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"),
        F.sum(F.when((F.col("rank") <= k) & F.col("hit"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("relevant").cast("int"), F.lit(k)))), F.lit(0.0), lambda s, x: s + 1 / F.log2(x + 1))
    return got.select(
        "query_id", "precision_at_5", F.round(F.coalesce(F.try_divide("found", "relevant"), F.lit(0.0)), 6).alias("recall_at_k"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.coalesce(F.try_divide(F.col("dcg"), best), F.lit(0.0)), 6).alias("ndcg"),
    )


def percentiles(values: DataFrame, column: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99), by: str = "kind") -> DataFrame:
    """Nearest-rank percentiles: the value at place ceil(p n); nulls come last.

    Equal values are counted first. The counts are range-partitioned, so a group of any size is
    spread over many tasks; places are found from the sizes of the partitions before.
    """
    counted = values.groupBy(by, column).agg(F.count("*").alias("_c"))
    order = [F.asc(by), F.asc_nulls_last(column)]
    ranged = materialize(counted.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(by, "_part").agg(F.sum("_c").alias("_size"))
    sizes = sizes.select(by, "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy(by)).alias("_all"))
    inside = F.sum("_c").over(Window.partitionBy(by, "_part").orderBy(F.asc_nulls_last(column)))
    placed = ranged.withColumn("_upto", inside).join(sizes, [by, "_part"]).withColumn("_upto", F.col("_upto") + F.col("_before"))
    picks = [F.max(F.when((F.ceil(p * F.col("_all")) <= F.col("_upto")) & (F.ceil(p * F.col("_all")) > F.col("_upto") - F.col("_c")), F.col(column))).alias(f"p{round(100 * p)}") for p in shares]
    return placed.groupBy(by).agg(*picks)
