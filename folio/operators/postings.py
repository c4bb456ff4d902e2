"""Lexical index: postings by kind, term statistics, and the retrievers that need nothing else.

A conjunction of terms is one relational division (group the matching postings by unit and count
the terms), so n terms cost one shuffle on the matching rows and no join order has to be chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import text as T

#: BM25 with a constant average length.
K1, B, AVERAGE = 1.2, 0.75, 120.0


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """One row for each key: the one stored last; of those stored at one time the one with the greatest hash."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last(at), F.desc(F.xxhash64(*df.columns)))
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def postings(units: DataFrame, kinds: str = "wfir") -> DataFrame:
    """kind, term, unit_id, document_id, length (words of the unit), tf: w words, f folded words that are no word of the
    unit, i identifiers, r reversed words with a digit. Units are partitioned by their id before they are taken
    apart, so the counts of a unit need no shuffle of their own."""
    words = T.tokens(F.col("text"))
    terms = {
        "w": F.col("_words"), "f": F.array_except(T.fold(F.col("_words")), F.col("_words")), "i": T.identifiers(F.col("text")),
        "r": F.transform(F.filter("_words", lambda w: w.rlike("[0-9]") & (F.length(w) >= 3)), F.reverse),
    }

    def entries(kind: str) -> Column:
        return F.transform(terms[kind], lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))

    base = units.select("unit_id", "document_id", "text").repartition("unit_id").withColumn("_words", words)
    every = base.select("unit_id", "document_id", F.size("_words").alias("length"), F.inline(F.concat(*map(entries, kinds))))
    return every.groupBy("kind", "term", "unit_id", "document_id", "length").agg(F.count("*").alias("tf"))


def vocabulary(words: DataFrame) -> DataFrame:
    """Terms that a typing error may be corrected to."""
    return words.where(F.col("term").rlike("^[a-z]{4,32}$")).select("term", F.length("term").alias("length")).distinct()


def document_frequency(words: DataFrame) -> DataFrame:
    return words.groupBy("term").agg(F.count_distinct("unit_id").alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, df: Column, n: Column, length: Column) -> Column:
    return idf(df, n) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / AVERAGE))


def ranked(units: DataFrame, terms: list[str], need: int | None = None, forms: DataFrame | None = None) -> DataFrame:
    """unit_id, document_id, matched, score of the units with at least ``need`` (all) of the different terms.
    forms (word, term): the words that count as a term, where it is not only the term itself.

    One pass over the units: the words of a unit are counted in place, so only matching
    (unit, term) rows leave the scan; their document frequencies are a small side.
    """
    terms = list(dict.fromkeys(terms))
    base = units.select("unit_id", "document_id", T.tokens(F.col("text")).alias("words"))
    total = base.agg(F.count("*").alias("n"))
    held = base.select("unit_id", "document_id", F.size("words").alias("length"), F.explode("words").alias("term" if forms is None else "word"))
    hits = held.where(F.col("term").isin(terms)) if forms is None else held.join(forms, "word")
    hits = hits.groupBy("unit_id", "document_id", "length", "term").agg(F.count("*").alias("tf"))
    # At most one row for each asked term, and one row: bounded by the question.
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(total))
    scored = scored.withColumn("s", bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("length")))
    found = scored.groupBy("unit_id", "document_id").agg(F.count("*").alias("matched"), F.round(F.sum("s"), 6).alias("score"))
    return found.where(F.col("matched") >= (len(terms) if need is None else need))


def with_phrase(units: DataFrame, phrase: str) -> DataFrame:
    """Units that hold the phrase's words next to each other."""
    wanted = " ".join(T.split_words(phrase))
    joined = F.concat(F.lit(" "), F.concat_ws(" ", T.tokens(F.col("text"))), F.lit(" "))
    return units.where(joined.contains(f" {wanted} "))


def starting(words: DataFrame, prefix: str) -> DataFrame:
    return words.where(F.col("term").startswith(prefix))


def corrections(terms: DataFrame, asked: str, most_rows: int | None = 5) -> DataFrame:
    """Vocabulary words that ``asked`` may be a typing error of: same first letter, similar length and
    trigrams; an edit (a swap of neighbours is one) for short words, two for long ones; the nearest.
    Only the reported rows are limited."""
    most = 1 if len(asked) < 8 else 2
    near = terms.where(F.col("term").startswith(asked[:1]) & F.abs(F.length("term") - len(asked)).between(0, 2))
    near = near.where(F.levenshtein("term", F.lit(asked)) <= 2 * most).where(T.trigram_similarity(F.col("term"), F.lit(asked)) >= 0.3)
    near = near.withColumn("distance", T.edit_distance_udf(F.col("term"), F.lit(asked))).where(F.col("distance") <= most)
    found = near.withColumn("_r", F.rank().over(Window.partitionBy(F.lit(1)).orderBy("distance"))).where("_r = 1").select("term", "distance")
    return found if most_rows is None else found.orderBy("term").limit(most_rows)
