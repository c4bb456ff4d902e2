"""Further retrievers; each gives candidates (document_id, unit_id, match_type, raw_score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import postings as P
from folio.operators.rank import longest_names
from folio.plans.packs import Domain

# Concepts of the domain with the clause type they name and the ways to say them.
CONCEPTS = {
    "termination": ("termination", ("early termination", "end the contract", "terminate")), "payment": ("payment", ("payment terms", "thirty days", "invoice")), "secrecy": ("confidentiality", ("confidential information", "keep secret")),
    "dispute": ("dispute_resolution", ("disputes between", "arbitration")), "law": ("governing_law", ("governing law", "courts at")), "guarantee": ("warranty", ("warrants to", "warranty")),
}


def _found(df: DataFrame, match: str, score) -> DataFrame:
    return df.select("document_id", "unit_id", F.lit(match).alias("match_type"), score.cast("double").alias("raw_score"))


def ocr_tolerant(units: DataFrame, words: list[str]) -> DataFrame:
    """Units that hold the folded words next to each other in their folded text."""
    folded = T.fold(T.tokens(F.col("text")))
    wanted = F.array_join(T.fold(F.array(*map(F.lit, words))), " ")
    return _found(units.where(F.concat(F.lit(" "), F.array_join(folded, " "), F.lit(" ")).contains(F.concat(F.lit(" "), wanted, F.lit(" ")))), "ocr_tolerant", F.lit(1.0))


def is_part(word: str) -> bool:
    """Whether a word may be a part of an identifier: four characters, a digit, no year."""
    return len(word) >= 4 and any(c.isdigit() for c in word) and not (len(word) == 4 and word[:2] in ("19", "20") and word.isdigit())


def partial_identifier(units: DataFrame, part: str) -> DataFrame:
    """Units with a word that starts or ends with a part of an identifier."""
    if not is_part(part):
        return _found(units.limit(0), "partial_identifier", F.lit(1.0))
    hit = F.exists(T.tokens(F.col("text")), lambda w: w.startswith(part) | w.endswith(part))
    return _found(units.where(hit), "partial_identifier", F.lit(1.0))


def filename(documents: DataFrame, words: list[str]) -> DataFrame:
    """Documents whose file name holds the words as one string, or else all of them (two at least)."""
    names = T.tokens(F.regexp_replace("filename", "_", " "))
    wanted = F.array(*map(F.lit, words))
    whole = F.concat_ws(" ", names).contains(" ".join(words))
    every = F.size(F.array_intersect(names, wanted)) == len(set(words))
    kept = documents.where(whole | every) if len(words) >= 2 else documents.where(whole)
    return kept.select("document_id", F.lit(None).cast("string").alias("unit_id"), F.when(whole, "filename").otherwise("filename_terms").alias("match_type"), F.lit(1.0).alias("raw_score"))


def entity(spark: SparkSession, entities: DataFrame, question: str) -> DataFrame:
    """Documents of persons, organisations and jurisdictions that the question names, with the first place of the name;
    organisations are compared without legal forms; longer names win."""
    grams = spark.createDataFrame([(g,) for g in T.question_ngrams(question)], "gram string")
    words = F.concat_ws(" ", T.tokens(F.col("value_norm")))
    spans = [F.col(c) if c in entities.columns else F.lit(None).cast("int").alias(c) for c in ("page", "char_start", "char_end")]
    kept = entities.where(F.col("type").isin("person", "organization", "jurisdiction"))
    names = F.array_distinct(F.when(F.col("type") == "organization", F.array(words, T.norm_org(F.col("value_norm")))).otherwise(F.array(words)))
    named = kept.select("document_id", F.explode(names).alias("name"), F.struct(*spans).alias("span"))
    hits = named.join(F.broadcast(grams), F.col("name") == F.col("gram")).groupBy("document_id", "name").agg(F.min("span").alias("span"))  # grams: bounded by the question
    longest = longest_names(hits.select(F.lit(1).alias("question"), "name").distinct()).select("name")
    found = hits.join(F.broadcast(longest), "name")  # at most one row for each gram
    return found.select("document_id", F.lit(None).cast("string").alias("unit_id"), F.lit("entity").alias("match_type"), F.length("name").cast("double").alias("raw_score"), "span.*")


def concepts_of(question: str, domain: Domain | None = None) -> list[tuple[str, str, tuple[str, ...]]]:
    """(name, clause type, ways to say it) of the concepts that a question names; those of a domain are added to the
    common ones, their clause type has their name."""
    low = T.normalize_exact(question)
    known = CONCEPTS | ({name: (name, ways) for name, ways in domain.concepts.items()} if domain else {})
    return [(name, kind, ways) for name, (kind, ways) in known.items() if name in low or any(w in low for w in ways)]


def contextual(units: DataFrame, clauses: DataFrame, question: str) -> DataFrame:
    """Clauses of a concept that the question names, and units that name it in another way."""
    out = _found(units.limit(0), "concept", F.lit(0.5))
    for _, kind, ways in concepts_of(question):
        out = out.unionByName(_found(clauses.where(F.col("clause_type") == kind).withColumn("unit_id", F.lit(None).cast("string")), "concept_clause", F.lit(1.0)))
        for way in ways:
            out = out.unionByName(_found(P.with_phrase(units, way), "concept", F.lit(0.5)))
    return out


def metadata(units: DataFrame, words: list[str]) -> DataFrame:
    """Document units that hold all the words."""
    held = F.array_intersect(T.tokens(F.col("text")), F.array(*map(F.lit, words)))
    return _found(units.where((F.col("unit_type") == "document") & (F.size(held) == len(set(words)))), "metadata", F.lit(1.0))


def unmatched(units: DataFrame, words: list[str]) -> DataFrame:
    """Words of a question that no unit holds."""
    asked = units.sparkSession.createDataFrame([(w,) for w in dict.fromkeys(words)], "word string")
    held = units.select(F.explode(F.array_intersect(T.tokens(F.col("text")), F.array(*map(F.lit, words)))).alias("word")).distinct()
    return asked.join(held, "word", "left_anti")
