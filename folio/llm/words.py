"""Words as the test data defines them: maximal runs of letters and digits, lower-cased."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def rows(batches: Iterator[pa.RecordBatch], at_most: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that are small enough for long texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, at_most):
            yield batch.slice(start, at_most)
