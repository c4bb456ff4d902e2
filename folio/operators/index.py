"""The stored lexical index: postings by kind and bucket of the term, sorted by term, beside the
deduplicated units and the terms with their document frequencies.

A question reads the buckets of its terms only (partition pruning), and of those the row groups that
may hold them (statistics of the sorted files). Phrases are verified on the candidates of their words.
Statistics are those of the whole collection, whatever filter a question has.

Kinds: w words, s stems, f folded words that are no word of the unit, i identifiers, r reversed words
with a digit, n words of file names (one posting a document, without a unit).
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.durable import exists, own_folder
from folio.functions import text as T
from folio.functions.stem import stem, with_stems
from folio.operators import postings as P

KINDS = "wsfirn"
#: Buckets of terms, and of units; with the kinds the folders of the index.
TERM_BUCKETS, UNIT_BUCKETS = 32, 32


#: Indexes in use, by folder: their files are listed once.
_OPEN: dict[str, Index] = {}


def _bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(c.cast("binary")), F.lit(buckets)).cast("int")


def _of(term: str) -> int:
    """The bucket of a term, as the stored column has it."""
    return zlib.crc32(term.encode()) % TERM_BUCKETS


class Index:
    """An index in a folder. Its tables are read lazily; nothing is kept on the driver but the schema. An index
    of one tenant has the tenant in every row, and every read asks for it."""

    def __init__(self, spark: SparkSession, path: str, tenant: str | None = None):
        self.spark, self.path, self.tenant = spark, path, tenant
        self._tables: dict[str, DataFrame] = {}

    @classmethod
    def build(cls, units: DataFrame, documents: DataFrame, path: str, tenant: str | None = None) -> Index:
        """Write the index of units (unit_id, document_id, text, ...; one row each) and of the file names of
        documents. Writes are rebalanced, so the postings of a very common term are spread over tasks."""
        spark = units.sparkSession
        own = units.withColumn("length", F.size(T.tokens(F.col("text")))).withColumn("bucket", _bucket(F.col("unit_id"), UNIT_BUCKETS))
        self = cls(spark, path, tenant)
        self._owned(own).hint("rebalance", "bucket").sortWithinPartitions("bucket", "unit_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/units")
        stored = self.units()
        words = P.postings(stored, "wfir").select("kind", "term", "unit_id", "document_id", "tf", "length")
        names = documents.select("document_id", F.explode(T.tokens(F.regexp_replace("filename", "_", " "))).alias("term")).groupBy("document_id", "term").agg(F.count("*").alias("tf"))
        names = names.select(F.lit("n").alias("kind"), "term", F.lit(None).cast("string").alias("unit_id"), "document_id", "tf", F.lit(0).alias("length"))
        self._write(words.unionByName(names), "overwrite")
        self._tables.clear()
        # Stems are taken of the different words only.
        stems = with_stems(self.postings("w")).groupBy(F.lit("s").alias("kind"), F.col("stem").alias("term"), "unit_id", "document_id", "length").agg(F.sum("tf").alias("tf"))
        self._write(stems.select("kind", "term", "unit_id", "document_id", "tf", "length"), "append")
        self._tables.clear()
        terms = self._read("postings").groupBy("kind", "term").agg(F.count("*").alias("df"))
        self._owned(terms).hint("rebalance", "kind").sortWithinPartitions("kind", "term").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/terms")
        self._owned(stored.agg(F.count("*").alias("n"))).write.mode("overwrite").parquet(f"{path}/totals")
        return cls(spark, path, tenant)

    @classmethod
    def stored(cls, spark: SparkSession, folder: str, units: DataFrame, documents: DataFrame, tenant: str | None = None) -> Index:
        """The index of a data folder (and tenant) in the shared folder, written when it is asked for first in an application."""
        path = f"{own_folder(spark)}/index-{hashlib.md5(f'{folder}|{tenant or ""}'.encode()).hexdigest()}"
        if not exists(spark, f"{path}/totals/_SUCCESS"):
            _OPEN[path] = cls.build(units, documents, path, tenant)
        return _OPEN.setdefault(path, cls(spark, path, tenant))

    def _write(self, postings: DataFrame, mode: str) -> None:
        placed = self._owned(postings).withColumn("bucket", _bucket(F.col("term"), TERM_BUCKETS))
        placed.hint("rebalance", "kind", "bucket").sortWithinPartitions("kind", "bucket", "term").write.mode(mode).partitionBy("kind", "bucket").parquet(f"{self.path}/postings")

    def _owned(self, df: DataFrame) -> DataFrame:
        return df if self.tenant is None else df.withColumn("tenant_id", F.lit(self.tenant))

    def _read(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.path}/{name}")
        df = self._tables[name]
        return df if self.tenant is None else df.where(F.col("tenant_id") == F.lit(self.tenant)).drop("tenant_id")

    def units(self) -> DataFrame:
        return self._read("units").drop("bucket", "length")

    def total(self) -> DataFrame:
        return self._read("totals")

    def postings(self, kind: str, terms: list[str] | None = None) -> DataFrame:
        """term, unit_id, document_id, tf, length; of the given terms only their buckets are read."""
        held = self._read("postings").where(F.col("kind") == kind)
        if terms is not None:
            held = held.where(F.col("bucket").isin(sorted(set(map(_of, terms)))) & F.col("term").isin(list(terms)))
        return held.drop("kind", "bucket")

    def terms(self, kind: str) -> DataFrame:
        return self._read("terms").where(F.col("kind") == kind).drop("kind")

    def text_of(self, found: DataFrame) -> DataFrame:
        """The units of found (unit_id): only the buckets concerned are read where few are."""
        wanted = found.select("unit_id").distinct().withColumn("bucket", _bucket(F.col("unit_id"), UNIT_BUCKETS))
        return self._read("units").join(wanted, ["bucket", "unit_id"], "left_semi").drop("bucket", "length")

    def ranked(self, terms: list[str], need: int | None = None, kind: str = "w", same: dict[str, str] | None = None) -> DataFrame:
        """unit_id, document_id, matched, score (BM25) of the units with at least ``need`` (all) of the terms.
        same: further stored terms that count as a term of the question."""
        terms = list(dict.fromkeys(terms))
        asked = {**{t: t for t in terms}, **(same or {})}
        hits = self.postings(kind, list(asked))
        if same:
            as_asked = F.create_map(*[F.lit(x) for kv in asked.items() for x in kv])[F.col("term")]
            hits = hits.withColumn("term", as_asked).groupBy("unit_id", "document_id", "length", "term").agg(F.sum("tf").alias("tf"))
        df = hits.groupBy("term").agg(F.count("*").alias("df"))  # all postings of the terms are at hand
        scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(self.total()))  # a row for each term; one row
        found = scored.groupBy("unit_id", "document_id").agg(F.count("*").alias("matched"), F.round(F.sum(P.bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("length"))), 6).alias("score"))
        return found.where(F.col("matched") >= (len(terms) if need is None else need))

    def ranked_batch(self, questions: DataFrame, k: int = 10) -> DataFrame:
        """question_id, unit_id, document_id, score, rank: the best k units with all terms, for many questions (question_id,
        terms array<string>) in one plan."""
        asked = questions.select("question_id", F.array_distinct("terms").alias("terms"))
        each = asked.select("question_id", F.size("terms").alias("need"), F.explode("terms").alias("term")).withColumn("bucket", _bucket(F.col("term"), TERM_BUCKETS))
        hits = self._read("postings").where(F.col("kind") == "w").join(each, ["bucket", "term"]).join(self.terms("w"), "term").crossJoin(F.broadcast(self.total()))
        found = hits.groupBy("question_id", "need", "unit_id", "document_id").agg(F.count("*").alias("matched"), F.round(F.sum(P.bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("length"))), 6).alias("score"))
        from pyspark.sql.window import Window

        best = Window.partitionBy("question_id").orderBy(F.desc("score"), "unit_id")
        return found.where(F.col("matched") == F.col("need")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("question_id", "unit_id", "document_id", "score", "rank")

    def phrase(self, phrase: str) -> DataFrame:
        """unit_id, document_id, text of the units that hold the phrase: those with all its words, verified."""
        words = list(dict.fromkeys(T.split_words(phrase)))
        if not words:
            return self.units().limit(0)
        held = self.postings("w", words).groupBy("unit_id").agg(F.count("*").alias("n")).where(F.col("n") == len(words))
        return P.with_phrase(self.text_of(held), phrase)

    def identifier(self, identifier: str) -> DataFrame:
        return self.postings("i", [identifier]).select("unit_id", "document_id")

    def folded(self, words: list[str]) -> DataFrame:
        """Units whose folded text holds the folded words next to each other."""
        wanted = T.folded_words(words)
        several = list(dict.fromkeys(wanted))
        both = self.postings("w", several).unionByName(self.postings("f", several))
        held = both.groupBy("unit_id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(several))
        joined = F.concat(F.lit(" "), F.array_join(T.fold(T.tokens(F.col("text"))), " "), F.lit(" "))
        return self.text_of(held).where(joined.contains(f" {' '.join(wanted)} "))

    def starting(self, prefix: str, kind: str = "w") -> DataFrame:
        return self._read("postings").where((F.col("kind") == kind) & F.col("term").startswith(prefix)).drop("kind", "bucket")

    def part(self, part: str) -> DataFrame:
        """Units with a word that starts or ends with the part."""
        return self.starting(part).unionByName(self.starting(part[::-1], "r")).select("unit_id", "document_id").distinct()

    def named(self, words: list[str]) -> DataFrame:
        """document_id of the documents whose file name holds all the words."""
        words = list(dict.fromkeys(words))
        return self.postings("n", words).groupBy("document_id").agg(F.count("*").alias("n")).where(F.col("n") == len(words)).select("document_id")

    def known(self, words: list[str]) -> set[str]:
        """Those of the words that some unit holds."""
        if not words:
            return set()
        return {r["term"] for r in self.terms("w").where(F.col("term").isin(sorted(set(words)))).select("term").collect()}

    def corrections(self, word: str, most: int = 5) -> list[str]:
        """Known words that an unknown one may be a typing error of. At most ``most`` are reported."""
        return [r["term"] for r in P.corrections(P.vocabulary(self.terms("w")), word, most).collect()]

    def unknown(self, words: list[str]) -> list[str]:
        """Words that no unit holds in any form: neither the word nor one with its stem."""
        held = {r["term"] for r in self.postings("s", [stem(w) for w in words]).select("term").distinct().collect()} if words else set()
        return [w for w in dict.fromkeys(words) if stem(w) not in held]
