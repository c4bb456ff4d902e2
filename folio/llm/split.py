"""Problem 1: splitting oversized units at natural boundaries.

Agglomerative merging. The text is cut into atoms: level by level from coarse to fine, until every
segment fits; the level that was needed is the boundary reported. Neighbouring atoms stand in a heap; the pair with
the weakest boundary is merged first, as long as the two together and the overlap fit the limit.
What remains are the pieces, cut at the strongest boundaries that the limit allows.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Boundary levels from coarse to fine; a segment ends where the separator begins.
LEVELS = (
    ("paragraph", re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")),
    ("line", re.compile(r"\n+")),
    ("sentence", re.compile(r"(?<=[.!?])[ \n]+")),
    ("word", re.compile(r"[ \n]+")),
)
#: How strongly a boundary holds its sides apart.
STRENGTH = {"paragraph": 4, "line": 2, "sentence": 3, "word": 1, "none": 0}
SCHEMA = "piece_no int, text string, char_start int, char_end int, overlap int, boundary string"


def atoms(text: str, size: int) -> tuple[str, dict[int, int]]:
    """The level whose segments all fit in ``size`` (or none), and the places where an atom begins, with the
    strength of the boundary there: those of that level and of the ones above it."""
    found: dict[int, int] = {}
    level = "none"
    for name, separator in LEVELS:
        end, longest = 0, 0
        for m in separator.finditer(text):
            longest = max(longest, m.start() - end)
            end = m.end()
            if 0 < end < len(text):
                found[end] = max(found.get(end, 0), STRENGTH[name])
        if max(longest, len(text) - end) <= size:
            level = name
            break
    marks = [0, *sorted(found), len(text)]
    for a, b in zip(marks, marks[1:]):  # only stretches without any boundary, and those with long separators
        while b - a > size:
            c = a + size
            while c > a + max(1, size // 2) and unicodedata.combining(text[c]):
                c -= 1
            found[c] = STRENGTH["none"]
            a = c
    return level, found


def split_text(text: str, max_chars: int, overlap_chars: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The boundary level and the pieces (start, end, overlap): text[start:end] is the piece and its
    first ``overlap`` characters repeat the end of the piece before. Without the overlaps the
    pieces make up the text exactly."""
    room = max(1, max_chars - max(0, overlap_chars))
    level, found = atoms(text, room)
    starts = [0, *sorted(found)]
    ends = [*starts[1:], len(text)]
    after = list(range(1, len(starts))) + [-1]
    before = [-1, *range(len(starts) - 1)]
    alive = [True] * len(starts)
    stamp = [0] * len(starts)
    heap = [(found[starts[i]], ends[i] - starts[i - 1], starts[i], i, 0, 0) for i in range(1, len(starts))]
    heapq.heapify(heap)
    while heap:
        _, _, _, i, s, t = heapq.heappop(heap)
        j = before[i] if alive[i] else -1
        if j < 0 or stamp[i] != s or stamp[j] != t or ends[i] - starts[j] > room:
            continue  # stale, or too long: both sides only grow, so it never fits later
        ends[j], after[j], alive[i] = ends[i], after[i], False
        stamp[j] += 1
        n = after[i]
        if n >= 0:
            before[n] = j
            heapq.heappush(heap, (found[starts[n]], ends[n] - starts[j], starts[n], n, stamp[n], stamp[j]))
        if (p := before[j]) >= 0:
            heapq.heappush(heap, (found[starts[j]], ends[j] - starts[p], starts[j], j, stamp[j], stamp[p]))
    pieces = []
    for i in (i for i in range(len(starts)) if alive[i]):
        a = starts[i]
        low = max(0, a - max(0, overlap_chars))
        if a > 0 and low < a:
            low = next((m.end() for m in LEVELS[3][1].finditer(text, max(0, low - 1), a) if low <= m.end() < a), a if level != "none" else low)
        pieces.append((low if a > 0 else 0, ends[i], a - low if a > 0 else 0))
    return level, pieces


def split_units(units: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of all units that are longer than ``max_chars`` of their unit_type.

    units: unit_id, unit_type, text, and stored_at, char_start if present; limits: unit_type, max_chars,
    overlap_chars. Out: unit_id, piece_no (from 1), text, char_start, char_end (within the unit's
    text), overlap (leading characters repeated from the piece before), boundary (the level used).

    Units with null text, null id, no limit or a fitting length have no rows. Of several rows of a
    unit_id the latest stored one counts (ties: the greatest text). Each piece has at most max_chars
    characters where overlap_chars < max_chars; a limit under 1 counts as 1. The filter and the
    join run before anything is shuffled; only the long units are, to drop their copies.
    Limits are one row per unit type: the planner broadcasts them only while they are small.
    """
    limits = limits.select("unit_type", "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars")).dropDuplicates(["unit_type"])
    stored = F.col("stored_at") if "stored_at" in units.columns else F.lit(None).cast("timestamp")
    long = (
        units.select("unit_id", "unit_type", F.col("text").alias("_text"), stored.alias("_stored"))
        .where(F.col("unit_id").isNotNull())
        .join(limits, "unit_type")
        .where(F.length("_text") > F.col("max_chars"))
    )
    latest = Window.partitionBy("unit_id").orderBy(F.desc_nulls_last("_stored"), F.desc("_text"))
    long = long.withColumn("_n", F.row_number().over(latest)).where("_n = 1").select("unit_id", "_text", "max_chars", "overlap_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = [[] for _ in range(7)]
                for unit, text, most, overlap in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                    level, pieces = split_text(text, max(1, most), overlap)
                    for n, (a, b, over) in enumerate(pieces, 1):
                        for column, value in zip(out, (unit, n, text[a:b], a, b, over, level)):
                            column.append(value)
                kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                names = ("unit_id", "piece_no", "text", "char_start", "char_end", "overlap", "boundary")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return long.mapInArrow(run, f"unit_id string, {SCHEMA}")


def rejoined(pieces: DataFrame, units: DataFrame, limits: DataFrame) -> DataFrame:
    """(unit_id, boundary, whole, fits, overlaps) of the pieces of each unit: the hash of their text without the
    overlaps, whether none is over its limit, and whether each begins as the one before it ends, by no
    more than the overlap allowed. The pieces of one unit come together in one row."""
    limits = limits.select("unit_type", "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("most")).dropDuplicates(["unit_type"])
    before = F.lag("text").over(Window.partitionBy("unit_id").orderBy("piece_no"))
    repeated = F.when(F.col("piece_no") == 1, F.col("overlap") == 0).otherwise(F.endswith(before, F.substring("text", F.lit(1), F.col("overlap"))))
    own = F.struct("piece_no", F.substring("text", F.col("overlap") + 1, F.length("text")).alias("own"))
    one = pieces.withColumn("repeated", repeated).groupBy("unit_id").agg(
        F.first("boundary").alias("boundary"), F.array_sort(F.collect_list(own)).alias("own"), F.max(F.length("text")).alias("longest"), F.max("overlap").alias("overlap"), F.every("repeated").alias("repeated")
    )
    kinds = units.select("unit_id", "unit_type").join(limits, "unit_type").groupBy("unit_id").agg(F.max("max_chars").alias("max_chars"), F.max("most").alias("most"))
    whole = F.md5(F.array_join(F.col("own.own"), "").cast("binary")).alias("whole")
    return one.join(kinds, "unit_id").select("unit_id", "boundary", whole, (F.col("longest") <= F.col("max_chars")).alias("fits"), (F.col("repeated") & (F.col("overlap") <= F.col("most"))).alias("overlaps"))
