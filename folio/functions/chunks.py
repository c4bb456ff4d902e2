"""Retrieval units of a page: passages bounded by sentences with an overlap, rows of tables, the document."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.extract import sentences
from folio.sources.parsers import block_type

TARGET, SLACK = 1000, 1.25
UNITS = "document_id string, page int, ordinal int, unit_type string, text string, context string, char_start int, char_end int"


def passages(text: str, target: int = TARGET) -> list[tuple[int, int]]:
    """Spans of about ``target`` characters that begin and end with sentences; the next one repeats the last sentences."""
    overlap = max(80, target // 7)
    spans, found = sentences(text), []
    at = 0
    while at < len(spans):
        start, end = spans[at]
        stop = at
        while stop + 1 < len(spans) and spans[stop + 1][1] - start <= (target if end - start >= target * 0.6 else target * SLACK):
            stop += 1
            end = spans[stop][1]
        found.append((start, end))
        if stop + 1 >= len(spans):
            break
        back = stop + 1
        while back - 1 > at and end - spans[back - 1][0] <= overlap:
            back -= 1
        at = back
    return found


def page_units(text: str) -> list[tuple[str, str, str | None, int, int]]:
    """(type, text, context, start, end): rows of tables with the table's header, and passages of the rest."""
    found, at, prose_start = [], 0, None
    for part in text.split("\n\n"):
        if block_type(part) == "table":
            lines, offset = part.split("\n"), at + len(part.split("\n")[0]) + 1
            for line in lines[1:]:
                found.append(("table_row", line, lines[0], offset, offset + len(line)))
                offset += len(line) + 1
            if prose_start is not None:
                found += [("passage", text[prose_start + a : prose_start + b], None, prose_start + a, prose_start + b) for a, b in passages(text[prose_start:at])]
                prose_start = None
        elif prose_start is None:
            prose_start = at
        at += len(part) + 2
    if prose_start is not None:
        found += [("passage", text[prose_start + a : prose_start + b], None, prose_start + a, prose_start + b) for a, b in passages(text[prose_start:])]
    return sorted(found, key=lambda u: u[3])


def chunk_pages(pages: DataFrame) -> DataFrame:
    """The units of every page (document_id, page, text); units never cross a page; null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for document, page, text in zip(*(c.to_pylist() for c in batch.columns)):
                for n, unit in enumerate(page_units(text or ""), 1):
                    for column, value in zip(out, (document, page, n, *unit)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [c.split()[0] for c in UNITS.split(", ")])

    return pages.select("document_id", "page", "text").mapInArrow(run, UNITS)


def document_unit(title: Column, doc_type: Column, filename: Column, *key_fields: Column) -> Column:
    """The text of a document's own unit: title, type in words, file name and key fields, one a line; missing ones left out."""
    return F.concat_ws("\n", title, F.replace(doc_type, F.lit("_"), F.lit(" ")), filename, *key_fields)


def labelled_row(header: Column, row: Column) -> Column:
    """A row of a table with its header's names: ``Header: value; ...``; empty cells are left out."""
    cells = [F.transform(F.split(c, r"\|"), lambda x: F.trim(x)) for c in (header, row)]
    both = F.zip_with(*cells, lambda h, v: F.when((v != "") & (F.coalesce(h, F.lit("")) != ""), F.concat(h, F.lit(": "), v)).when(v != "", v))
    return F.array_join(F.array_compact(both), "; ")
