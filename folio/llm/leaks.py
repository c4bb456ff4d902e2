"""Problem 7: passages of held-out test items inside the corpus.

The items are the collection of a BM25 inverted index; every passage of the corpus is a query, its
words counted as often as they stand in it. Items lie in blocks. A passage's score is first
bounded by the greatest weights of each block (block-max WAND): the blocks whose bound reaches
their least threshold are the pivots, all others are skipped, and only in the pivots are posting
lists read and items scored. The threshold of an item is proven: a passage that holds ``run``
consecutive words of the item scores at least the least sum of weights over all such windows of
the item, so no leak is below it. Passages overlap so far that every ``run`` consecutive words
stand in one of them, around its middle word; a candidate is verified by laying passage and
item upon each other at that word and comparing outward, word by word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.words import rows, words

#: BM25 parameters and consecutive words that make a leak (defaults).
K1, B, RUN = 1.2, 0.75, 12
#: Items of a block, items of one index (a shard), shards of one pass over the corpus.
BLOCK, SHARD, SHARDS_A_PASS = 32, 4096, 8
#: Words of a text that are scored at once (bounds the memory of a task).
SEGMENT = 16_384


class ItemIndex:
    """Inverted index of items: posting lists by block, with the greatest weight of each word in each block."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int = RUN):
        self.run = run
        items = [(i, w) for i, w in items if len(w) >= run]
        self.ids = [i for i, _ in items]
        self.number: dict[str, int] = {}
        self.texts = [[self.number.setdefault(w, len(self.number)) for w in text] for _, text in items]
        n, self.other = len(items), len(self.number)
        mean = sum(map(len, self.texts)) / n if n else 1.0
        counts = [Counter(text) for text in self.texts]
        df = np.zeros(self.other)
        for tf in counts:
            df[list(tf)] += 1
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weights = [{k: idf[k] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(text) / mean)) for k, f in tf.items()} for tf, text in zip(counts, self.texts)]
        self.places: list[dict[int, list[int]]] = []
        least = np.empty(n)
        for col, text in enumerate(self.texts):
            at: dict[int, list[int]] = {}
            for p, k in enumerate(text):
                at.setdefault(k, []).append(p)
            self.places.append(at)
            sums = np.cumsum([0.0, *(weights[col][k] for k in text)])
            least[col] = (sums[run:] - sums[:-run]).min() * (1 - 1e-5)
        starts = range(0, n, BLOCK)
        self.bound = np.zeros((self.other + 1, len(starts)), np.float32)  # the last row is for other words
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # row of a word, weights of its postings, thresholds
        for b, first in enumerate(starts):
            inside = weights[first : first + BLOCK]
            held = np.unique(np.fromiter((k for w in inside for k in w), np.int64))
            row = np.full(self.other + 1, len(held))
            row[held] = np.arange(len(held))
            table = np.zeros((len(held) + 1, len(inside)), np.float32)
            for col, w in enumerate(inside):
                table[row[list(w)], col] = list(w.values())
            self.bound[held, b] = table[:-1].max(1)
            self.blocks.append((row, table, least[first : first + BLOCK]))
        self.least = np.array([thresholds.min() for *_, thresholds in self.blocks])

    def candidates(self, numbers: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place of the passage's middle word, item) of all passages and items that reach the item's threshold."""
        run = self.run
        steps = -(-len(numbers) // run)  # a passage is one step of ``run`` words and all but the last of the next
        padded = np.full(steps * run, self.other)
        padded[: len(numbers)] = numbers
        whole = len(numbers) // run  # passages whose middle word is one of the text
        reached = _sums(self.bound[padded], run)[:whole] >= self.least
        for b in np.nonzero(reached.any(0))[0]:
            row, table, least = self.blocks[b]
            hit = (_sums(table[row[padded]], run)[:whole] >= least) & reached[:, b, None]
            passages, items = np.nonzero(hit)
            yield from zip((passages * run + run - 1).tolist(), (items + b * BLOCK).tolist())

    def leaks(self, text: list[str]) -> dict[int, int]:
        """item id -> longest number of consecutive words of the item that the text holds (from run on)."""
        best: dict[int, int] = {}
        get, other, run = self.number.get, self.other, self.run
        if not self.ids:
            return best
        whole = [get(w, other) for w in text]
        numbers = np.array(whole, np.int64)
        for first in range(0, max(1, len(whole) - run + 1), SEGMENT):
            part = numbers[first : first + SEGMENT + run - 1]
            if len(part) < run:
                continue
            for at, col in self.candidates(part):
                at += first
                for p in self.places[col].get(whole[at], ()):
                    n = _overlap(whole, at, self.texts[col], p)
                    if n >= run and n > best.get(col, 0):
                        best[col] = n
        return {self.ids[col]: n for col, n in best.items()}


def _sums(weights: np.ndarray, run: int) -> np.ndarray:
    """Sums of the rows of each passage of 2 * run - 1 words; passages begin every ``run`` words."""
    steps = weights.reshape(-1, run, weights.shape[1])
    whole = steps.sum(1)
    out = whole.copy()
    out[:-1] += whole[1:] - steps[1:, -1]
    return out


def _overlap(text: list[int], at: int, item: list[int], p: int) -> int:
    """Length of the equal stretch around place ``at`` of the text and ``p`` of the item."""
    low = 1
    while low <= at and low <= p and text[at - low] == item[p - low]:
        low += 1
    high, most = 1, min(len(text) - at, len(item) - p)
    while high < most and text[at + high] == item[p + high]:
        high += 1
    return low + high - 1


@lru_cache(maxsize=SHARDS_A_PASS)
def _index(packed: bytes, run: int) -> ItemIndex:
    import pickle

    return ItemIndex([(i, words(t)) for i, t in pickle.loads(packed)], run)


def find_leaks(corpus: DataFrame, items: DataFrame, run: int = RUN, id_column: str = "doc_id", item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(id, item id, longest): each corpus row and each item of which it holds at least ``run``
    consecutive words, with the longest such run.

    Letter case, punctuation and white space don't matter. Null and short texts have no rows;
    repeated rows give repeated rows (equal ones). Rows of an item id are each an item, their
    results are merged by the caller. Other columns are not read. The test set is the stated query
    set: it is read in shards of at most SHARD items, each one index, and the corpus is read once
    for SHARDS_A_PASS of them. An empty table gives an empty result.
    """
    spark = corpus.sparkSession
    import pickle

    source = corpus.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).where(F.length("text") >= 2 * run - 1)
    asked = items.select(F.col(item_column).alias("item"), F.col(text_column).cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    id_type, item_type = source.schema["id"].dataType.simpleString(), asked.schema["item"].dataType.simpleString()
    shards: list = []
    part: list = []
    for row in asked.dropDuplicates().toLocalIterator():  # the test set, streamed
        part.append((row["item"], row["text"]))
        if len(part) == SHARD:
            shards.append(spark.sparkContext.broadcast(pickle.dumps(part)))
            part = []
    if part:
        shards.append(spark.sparkContext.broadcast(pickle.dumps(part)))

    def search(some: list):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            indexes = [_index(shard.value, run) for shard in some]
            for batch in rows(batches):
                texts = [(i, words(text)) for i, text in zip(*(c.to_pylist() for c in batch.columns))]
                found = [(i, item, n) for index in indexes for i, text in texts for item, n in index.leaks(text).items()]
                columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((batch.schema.field(0).type, None, pa.int32()))]
                if found:
                    yield pa.RecordBatch.from_arrays(columns, ["id", "item", "longest"])

        return find

    out = None
    schema = f"id {id_type}, item {item_type}, longest int"
    for at in range(0, len(shards), SHARDS_A_PASS):
        found = source.mapInArrow(search(shards[at : at + SHARDS_A_PASS]), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_column).withColumnRenamed("item", item_column)
