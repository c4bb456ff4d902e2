"""Problem 5: near-duplicate records by an inverted index of positional bytes.

A record is laid out as a sparse table of bytes: each of its word sequences (shingles) puts one byte,
taken from its hash, at one position, taken from other bits of it; the table has as many positions
as the collection needs for lists to stay short. Where several shingles of a record put the same
byte at the same position, the further ones go to further layers of the table, so two records
share at least as many positional bytes as shingles. The inverted index holds, for each position
and byte, the records that have it.

Count filtering. All positional bytes are put in one order, rare ones first, by counts over the whole
collection. Two records of similarity t or more share at least ``t`` of the larger one's shingles;
so of the first n - ceil(t n) + k positional bytes of each, at least k are shared, or all where the
pair shares fewer than k. Only these are indexed. Pairs are tallied by shared positional bytes,
pairs with fewer than k (or than the pair needs, if that is less) are dropped, and the rest are
verified on their whole shingle sets.

A shared entry must also leave enough of them behind it in both orders for the pair to reach
t at all; the first k shared entries of a true pair do, so others are not tallied.

Equal shingle sets are indexed once: such records form a class, and links between classes are
handed on to their members, without ever pairing copies within the index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.durable import materialize
from folio.llm.words import rows

#: Words of a shingle, similarity, least words of a text, shared index entries that are guaranteed.
SHINGLE, SIMILARITY, LEAST_WORDS, SHARED = 4, 0.6, 40, 3
#: Counters of the statistics for each record, and the least and greatest number of them (4 bytes each). Their
#: number decides how well the order tells rare from frequent, never the result.
COUNTERS_A_RECORD, LEAST_COUNTERS, MOST_COUNTERS = 8, 1 << 20, 1 << 24
#: Shingles of the collection for each position of the table of bytes.
SHINGLES_A_POSITION = 16
#: Bytes of the texts that are taken together.
PART_BYTES = 1 << 20
#: Length of a list of the index beyond which it is split over several tasks.
LONG_LIST = 20_000
#: Rows (of at most about 50 bytes) up to which a side of a join is sent to all executors.
BROADCAST_ROWS = 200_000
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _in_words() -> np.ndarray:
    """For each code point whether it is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


class Shingler:
    """Sets of 64-bit shingle hashes. Texts are taken together as one array of characters: words are found, hashed
    (a polynomial of their characters) and combined without a step of Python for each word."""

    def __init__(self, size: int):
        self.size = size
        self.powers = np.ones(1, np.uint64)

    def __call__(self, text: str) -> tuple[int, np.ndarray]:
        """Number of words and the sorted distinct shingle hashes."""
        words, shingles = self.several([text])
        return int(words[0]), np.unique(shingles[0])

    def several(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """For each text its number of words and the hashes of its shingles in order."""
        lower = [t.lower() for t in texts]
        stops = np.cumsum([len(t) + 1 for t in lower])
        codes = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = _in_words()[codes]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.concatenate(([0], edges))
        starts, lengths = edges[::2], edges[1::2] - edges[::2]  # the last character is a line feed, so every word ends
        last = np.searchsorted(starts, stops)
        first = np.concatenate(([0], last[:-1]))
        if not len(starts):
            return last - first, [np.empty(0, np.uint64)] * len(texts)
        if len(self.powers) < lengths.max():
            more = np.full(int(lengths.max()), _BASE, np.uint64)
            more[0] = 1
            self.powers = np.cumprod(more)
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        place = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
        h = np.add.reduceat((codes[inside].astype(np.uint64) + np.uint64(1)) * self.powers[place], begin)
        h = _mixed(h)
        n = len(h) - self.size + 1
        if n < 1:
            return last - first, [np.empty(0, np.uint64)] * len(texts)
        shingles = h[:n].copy()
        for k in range(1, self.size):
            shingles = (shingles ^ (shingles >> np.uint64(29))) * _MIX + h[k : n + k]
        shingles = _mixed(shingles)
        return last - first, [shingles[a : max(a, b - self.size + 1)] for a, b in zip(first.tolist(), last.tolist())]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def _prefix(n: int, similarity: float, shared: int) -> int:
    return min(n, n - math.ceil(round(similarity * n, 9)) + shared)


def _counts(texts: DataFrame, size: int, least: int, counters: int) -> np.ndarray:
    """How often the positional bytes of each counter occur, over all texts.

    Each task adds its texts up in one array of fixed size; the arrays are summed in blocks by
    a shuffle. What reaches the driver has the size of the counters (at most 64 MB).
    """
    blocks = 64
    width = counters // blocks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, total = Shingler(size), np.zeros(counters, np.uint32)
        for batch in _parts(batches):
            words, found = shingles.several(batch.column(1).to_pylist())
            several = [_salted(part, h) for part, n, h in zip(batch.column(0).to_pylist(), words, found) if n >= least]
            if several:
                total += np.bincount((np.concatenate(several) & np.uint64(counters - 1)).astype(np.int64), minlength=counters).astype(np.uint32)
        if total.any():
            parts = [b.tobytes() for b in total.reshape(blocks, width)]
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array(parts, pa.binary())], ["block", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint32)
        for raw in table.column("counts"):
            total += np.frombuffer(raw.as_py(), np.uint32)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    summed = texts.select("part", "text").mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary")
    out = np.zeros((blocks, width), np.uint32)
    for row in summed.collect():  # 64 rows
        out[row["block"]] = np.frombuffer(row["counts"], np.uint32)
    return out.reshape(-1)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most 500 with about PART_BYTES of texts (the last column); a longer text is alone."""
    for batch in rows(batches, 500):
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(size, (size[at - 1] if at else 0) + PART_BYTES))
            yield batch.slice(at, max(1, end - at))
            at += max(1, end - at)


def _power(least: float) -> int:
    """The least power of two that is not below ``least``."""
    return 1 << max(0, math.ceil(math.log2(max(1.0, least))))


@lru_cache(maxsize=64)
def _salt(part: str) -> np.uint64:
    return np.uint64(_hash(part))


def _salted(part: str, hashes: np.ndarray) -> np.ndarray:
    """Hashes by which records of different parts share nothing but by chance."""
    return hashes ^ _salt(part)


def positional_bytes(hashes: np.ndarray, positions: int) -> np.ndarray:
    """The sorted positional bytes of a record, each as position * 256 + byte. ``positions`` is a power of two;
    positions from there on belong to further layers, for bytes that the record has several times."""
    table = np.uint64(positions * 256)
    found = np.sort(hashes & (table - np.uint64(1)))
    again = found[1:] == found[:-1]
    if again.any():
        first = np.concatenate(([True], ~again))
        start = np.maximum.accumulate(np.where(first, np.arange(len(found)), 0))
        found = np.sort(found + (np.arange(len(found)) - start).astype(np.uint64) * table)
    return found


def near_duplicates(
    records: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, least_words: int = LEAST_WORDS, shared: int = SHARED
) -> tuple[DataFrame, DataFrame]:
    """(members, links) of a table (part, record_id, text); only records of one part are compared.

    members: part, class_id, record_id, text_id - records with at least ``least_words`` words, by
    the set of their shingles; text_id is equal for equal texts. links: class_a, class_b,
    similarity - all pairs of classes whose similarity (shared shingles divided by all) is at
    least ``similarity``, each once.
    Records with null, empty or short text are in neither, nor are those with a null id or part.
    Repeated rows count once. Other columns are not read. An empty table gives empty results.
    Shingles are compared by their 64-bit hashes.
    """
    spark = records.sparkSession
    source = records.select("part", "record_id", F.col("text").cast("string").alias("text")).where(
        (F.length("text") >= 2 * least_words - 1) & F.col("record_id").isNotNull() & F.col("part").isNotNull()
    )
    counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, _power(COUNTERS_A_RECORD * records.count())))
    counted = _counts(source, shingle, least_words, counters)
    positions = _power(max(counters / 256, int(counted.sum(dtype=np.int64)) / SHINGLES_A_POSITION))
    counts = spark.sparkContext.broadcast(counted)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shingles, weight, seen = Shingler(shingle), counts.value, set()
        number = TaskContext.get().partitionId() << 40
        for batch in _parts(batches):
            out: list[list] = [[] for _ in range(8)]
            every = [np.empty(0, np.int64)]
            words, found = shingles.several(batch.column(2).to_pylist())
            for part, record, text, n, h in zip(*(c.to_pylist() for c in batch.columns), words, found):
                if n < least_words:
                    continue
                h = np.unique(h)
                one = _class(part, h)
                entries, long = every[0], None
                new = one not in seen  # copies within a task are indexed once
                if new:
                    seen.add(one)
                    placed = positional_bytes(_salted(part, h), positions)
                    times = weight[(placed & np.uint64(counters - 1)).astype(np.int64)]
                    order = np.argsort(times, kind="stable")[: _prefix(len(h), similarity, shared)]
                    entries, times = placed[order].view(np.int64), times[order]
                    if times[-1] > LONG_LIST:  # frequent ones stand last; their lists are split
                        short = len(order) - int((times > LONG_LIST).sum())
                        long = [{"entry": int(e), "at": short + k, "tasks": int(t) // LONG_LIST + 1} for k, (e, t) in enumerate(zip(entries[short:], times[short:]))]
                        entries = entries[:short]
                number += 1
                every.append(entries)
                for column, value in zip(out, (part, record, one, _signed(_hash(text)), len(h), number, long, new)):
                    column.append(value)
            listed = pa.list_(pa.struct([("entry", pa.int64()), ("at", pa.int32()), ("tasks", pa.int32())]))
            kinds = (pa.string(), batch.schema.field(1).type, pa.int64(), pa.int64(), pa.int32(), pa.int64(), listed, pa.bool_())
            names = ["part", "record_id", "class_id", "text_id", "n", "number", "long", "indexed", "entries"]
            entries = pa.ListArray.from_arrays(pa.array(np.cumsum([len(e) for e in every]), pa.int32()), pa.array(np.concatenate(every)))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(out, kinds)), entries], names)

    kind = source.schema["record_id"].dataType.simpleString()
    schema = f"part string, record_id {kind}, class_id long, text_id long, n int, number long, long array<struct<entry:long,at:int,tasks:int>>, indexed boolean, entries array<long>"
    indexed = materialize(source.mapInArrow(index, schema))
    members = indexed.select("part", "class_id", "record_id", "text_id").distinct()
    # Of copies indexed by several tasks one stays. Only the others are joined, and they are few or,
    # where not, shuffled.
    emitted = indexed.where("indexed")
    first = emitted.groupBy("class_id").agg(F.count("*").alias("times"), F.min("number").alias("first")).where("times > 1")
    surplus = materialize(emitted.select("class_id", "number").join(first, "class_id").where("number <> first").select("number"))
    classes = emitted.join(_small(surplus), "number", "left_anti")
    place = F.expr("shiftleft(cast(n as long), 32) + at")
    # In the index a class goes by its number, which is short; its id is a hash.
    posted = classes.select("number", "n", F.posexplode("entries").alias("at", "entry")).select(*_split("entry"), "number", place.alias("place"))
    # Both sides are the same rows, so one shuffle serves both. The smaller set of a pair is side a.
    short = _sides(posted, posted, ["position", "byte"])
    # Of a long list each row of side a is in one task, side b in all of them.
    listed = classes.where("long IS NOT NULL").select("number", "n", F.inline("long")).select(*_split("entry"), "number", place.alias("place"), "tasks")
    one, every = F.pmod(F.xxhash64("number"), F.col("tasks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))
    both = [listed.withColumn("task", where).drop("tasks") for where in (one, every)]
    met = short.unionByName(_sides(*both, ["position", "byte", "task"]))
    n_a, n_b = F.shiftright("place_a", 32), F.shiftright("place_b", 32)
    at_a, at_b = F.col("place_a").bitwiseAND(F.lit(0xFFFFFFFF)), F.col("place_b").bitwiseAND(F.lit(0xFFFFFFFF))
    overlap = F.ceil(F.lit(similarity / (1 + similarity)) * (n_a + n_b) - 1e-6)
    smaller = (n_a < n_b) | ((n_a == n_b) & (F.col("number_a") < F.col("number_b")))
    close: Column = smaller & (at_a <= n_a - overlap + (shared - 1)) & (at_b <= n_b - overlap + (shared - 1))
    # A pair of small sets may reach t with fewer than k shared shingles in all; then each counts for more.
    weight = F.greatest(F.lit(1), F.ceil(shared / F.greatest(overlap, F.lit(1))))
    tallied = met.where(close).groupBy("number_a", "number_b").agg(F.sum(weight).alias("hits"))
    candidates = materialize(tallied.where(F.col("hits") >= shared).select("number_a", "number_b"))
    for side in "ab":
        candidates = candidates.join(classes.select(F.col("number").alias(f"number_{side}"), F.col("class_id").alias(f"class_{side}")), f"number_{side}")
    candidates = materialize(candidates.select("class_a", "class_b"))
    return members, _verified(candidates, classes, source, similarity, shingle)


def _split(entry: str) -> list[Column]:
    """Position and byte of an entry of the index."""
    return [F.shiftright(entry, 8).alias("position"), F.col(entry).bitwiseAND(F.lit(255)).alias("byte")]


def _sides(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """number_a, place_a, number_b, place_b of all that stand in the same lists."""
    named = [df.select(*on, F.col("number").alias(f"number_{side}"), F.col("place").alias(f"place_{side}")) for df, side in ((a, "a"), (b, "b"))]
    return named[0].join(named[1], on).drop(*on)


def _verified(candidates: DataFrame, classes: DataFrame, source: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The candidate pairs whose whole shingle sets are similar enough."""
    wanted = candidates.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).distinct()
    chosen = classes.select("class_id", "part", "record_id").join(wanted, "class_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(shingle)
        for batch in _parts(batches):
            found: list[list] = [[], []]
            for one, part, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingles.several(batch.column(2).to_pylist())[1]):
                h = np.unique(h)
                if _class(part, h) == one:
                    found[0].append(one)
                    found[1].append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.binary())], ["class_id", "hashes"])

    # A record id may stand in several rows with other texts; only those of the class itself are kept.
    texts = source.join(_small(materialize(chosen)), ["part", "record_id"]).select("class_id", "part", "text")
    hashed = texts.mapInArrow(sets, "class_id long, hashes binary").dropDuplicates(["class_id"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(both / (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike, pa.float64())], ["class_a", "class_b", "similarity"])

    hashed = materialize(hashed)
    left = candidates.join(hashed.withColumnsRenamed({"class_id": "class_a", "hashes": "hashes_a"}), "class_a")
    both = left.join(hashed.withColumnsRenamed({"class_id": "class_b", "hashes": "hashes_b"}), "class_b")
    pairs = both.select("class_a", "class_b", "hashes_a", "hashes_b").mapInArrow(verify, "class_a long, class_b long, similarity double")
    return pairs.where(F.col("similarity") >= similarity - 1e-9)


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcasting if it has at most BROADCAST_ROWS rows; else it is shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _class(part: str, hashes: np.ndarray) -> int:
    import xxhash

    return _signed(xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass") + b"\0" + hashes.tobytes()))


def linked_pairs(records: DataFrame, **options) -> DataFrame:
    """(part, id_a, id_b): all pairs of records with different texts that are near duplicates,
    id_a < id_b. Records with equal texts are no pair. Options and cases: near_duplicates."""
    members, links = near_duplicates(records, **options)
    members = materialize(members)
    a = members.select("part", F.col("class_id").alias("class_a"), F.col("record_id").alias("x"), F.col("text_id").alias("tx"))
    b = members.select(F.col("class_id").alias("class_b"), F.col("record_id").alias("y"), F.col("text_id").alias("ty"))
    between = links.select("class_a", "class_b").join(a, "class_a").join(b, "class_b").select("part", "x", "y")
    # Different texts with the same shingles, in classes that hold more than one text.
    several = members.groupBy("class_id").agg(F.min("text_id").alias("low"), F.max("text_id").alias("high")).where("low <> high").select("class_id")
    mixed = members.join(several, "class_id", "left_semi")
    within = (
        mixed.select("part", "class_id", F.col("record_id").alias("x"), F.col("text_id").alias("tx"))
        .join(mixed.select("class_id", F.col("record_id").alias("y"), F.col("text_id").alias("ty")), "class_id")
        .where("tx < ty")
        .select("part", "x", "y")
    )
    found = between.unionByName(within).where("x <> y")
    return found.select("part", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def grouped(records: DataFrame, **options) -> DataFrame:
    """(part, record_id, class_id, group_id, n_links): one row for each record of enough words. group_id is the
    least class of all classes that are connected by links; n_links counts the record's linked classes.

    Components are found by handing on the least id along the links, doubling the distance in each
    round; every round is written to the shared folder.
    """
    members, links = near_duplicates(records, **options)
    links = materialize(links.select("class_a", "class_b"))
    both = links.union(links.select("class_b", "class_a")).toDF("x", "y")
    label = materialize(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("g")))
    while True:
        near = both.join(label.select(F.col("x").alias("y"), "g"), "y").select("x", "g")
        far = label.join(label.select(F.col("x").alias("g"), F.col("g").alias("h")), "g").select("x", F.col("h").alias("g"))
        new = materialize(label.union(near).union(far).groupBy("x").agg(F.min("g").alias("g")))
        moved = new.join(label.withColumnRenamed("g", "old"), "x").where("g <> old").limit(1).count()
        label = new
        if not moved:
            break
    counted = both.groupBy("x").agg(F.count("*").alias("n_links"))
    out = members.select("part", "record_id", F.col("class_id").alias("x")).join(label, "x", "left").join(counted, "x", "left")
    return out.select("part", "record_id", F.col("x").alias("class_id"), F.coalesce("g", "x").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
