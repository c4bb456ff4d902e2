"""Search by meaning: what may be plugged in (embedder, scorer, retriever), a vector store, and plain stand-ins.

No model is shipped. HashEmbedder and overlap() need none: they are deterministic and tell texts with common
words and word parts apart from others; a model takes their place by the same protocol.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.durable import exists, materialize
from folio.functions import text as T
from folio.operators import rank as R
from folio.sources import sinks as S


class Embedder(Protocol):
    """Turns texts into vectors of ``size`` numbers; it is sent to the executors, so it must be picklable."""

    size: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Retriever(Protocol):
    """Gives candidates (the engine's CANDIDATE columns) for a plan; the engine keeps those inside the plan's filters."""

    name: str

    def retrieve(self, engine, plan) -> DataFrame: ...


class Scorer(Protocol):
    """Relevance of a text for a question, as a column."""

    def __call__(self, question: str, text: Column) -> Column: ...


class HashEmbedder:
    """Words and their character trigrams, each added to a few places of the vector given by a hash."""

    def __init__(self, size: int = 256):
        self.size = size

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for row, text in enumerate(texts):
            for word in T.split_words(text):
                if word in T.STOPWORDS:
                    continue
                padded = f"^{word}$"
                for part, weight in ((word, 2.0), *((padded[i : i + 3], 0.5) for i in range(len(padded) - 2))):
                    h = zlib.crc32(part.encode())
                    out[row, h % self.size] += weight if h >> 31 else -weight
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)


def overlap(question: str, text: Column) -> Column:
    """Share of the question's content words that the text holds."""
    words = [w for w in dict.fromkeys(T.split_words(question)) if w not in T.STOPWORDS] or [""]
    return F.size(F.array_intersect(T.tokens(text), F.array(*map(F.lit, words)))) / len(words)


def embedding_input(title: Column, context: Column, text: Column) -> Column:
    """What of a unit is embedded: the document's title, the unit's heading or table header, and its text."""
    return F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(context, F.lit("")), text)


def embedded(texts: DataFrame, embedder: Embedder, column: str = "text", batch: int = 256) -> DataFrame:
    """The rows with their vector (embedding array<float>), in batches of texts; null text has a null vector."""
    names = [c for c in texts.columns if c != column]
    schema = ", ".join([*(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in names), "embedding array<float>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                said = part.column(len(names)).to_pylist()
                vectors = embedder.embed([t or "" for t in said])
                held = pa.array([None if t is None else v.tolist() for t, v in zip(said, vectors)], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], held], [*names, "embedding"])

    return texts.select(*names, column).mapInArrow(run, schema)


class VectorStore:
    """Vectors of units (unit_id, document_id, embedding) in a folder, in versions: a reader of one version is not
    disturbed by the next. Search is exact."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _version(self) -> int:
        n = 0
        while exists(self.spark, f"{self.path}/v={n + 1}/_SUCCESS"):
            n += 1
        return n

    def vectors(self) -> DataFrame:
        n = self._version()
        return self.spark.read.parquet(f"{self.path}/v={n}") if n else self.spark.createDataFrame([], "unit_id string, document_id string, embedding array<float>")

    def upsert(self, new: DataFrame) -> None:
        """The vectors of the documents in ``new`` replace all that is stored of them."""
        self._write(S.replace_content(self.vectors(), new.select("unit_id", "document_id", "embedding")))

    def delete(self, gone: DataFrame) -> None:
        """Without the vectors of the documents in ``gone`` (document_id)."""
        self._write(S.delete(self.vectors(), gone))

    def _write(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={self._version() + 1}")

    def search(self, vector: np.ndarray, floor: float = R.FLOOR, margin: float = R.MARGIN) -> DataFrame:
        """unit_id, document_id, similarity of all units that are similar enough to one vector."""
        asked = self.spark.createDataFrame([(0, [float(x) for x in vector])], "query_id long, q array<double>")
        stored = self.vectors().select(F.col("unit_id").alias("vec_id"), F.col("document_id").alias("label"), "embedding")
        return R.within_margin(stored, asked, floor, margin).select(F.col("vec_id").alias("unit_id"), F.col("label").alias("document_id"), "similarity")


class Semantic:
    """The semantic retriever: the question's vector against the store's."""

    name = "semantic"

    def __init__(self, store: VectorStore, embedder: Embedder):
        self.store, self.embedder = store, embedder

    def retrieve(self, engine, plan) -> DataFrame:
        found = self.store.search(self.embedder.embed([plan.question])[0])
        none = [F.lit(None).cast("int").alias(c) for c in ("page", "char_start", "char_end")]
        return found.select("document_id", "unit_id", F.lit("semantic").alias("retriever"), F.lit("semantic").alias("match_type"), F.col("similarity").alias("raw_score"), F.lit("").alias("matched"), *none)


def reranked(found: DataFrame, question: str, scorer: Scorer, head: int = 40, chars: int = 1500) -> DataFrame:
    """Search results (rank, tier, snippet, ...) whose first ``head`` documents are put in order of relevance inside their tier;
    the first tier stays. The rest keeps its rank."""
    first = materialize(found.where(F.col("rank") <= head).withColumn("relevance", scorer(question, F.substring(F.coalesce("snippet", F.lit("")), 1, chars))))
    new = R.rerank(first.select("document_id", "rank", F.col("tier").alias("key"), "relevance")).select("document_id", "new_rank")
    return found.join(new, "document_id", "left").withColumn("rank", F.coalesce("new_rank", "rank")).drop("new_rank").orderBy("rank")
