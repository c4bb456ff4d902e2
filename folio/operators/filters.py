"""Structured filters. Each is a predicate or a semi join on a lazy DataFrame of documents; no id
list ever leaves the executors, and all of them reach the scans."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators.compute import DATE_FIELDS

AMOUNT_FIELDS = ("total_amount", "amount")
OPERATORS = (">", ">=", "<", "<=", "between")


def indexed(documents: DataFrame) -> DataFrame:
    """Only documents whose processing has ended count anywhere."""
    return documents.where("status = 'indexed'")


def of_types(documents: DataFrame, types: Iterable[str], hard: bool = True) -> DataFrame:
    """A soft type only lifts results later on; it filters nothing."""
    return documents.where(F.col("doc_type").isin(*types)) if hard else documents


def of_kinds(documents: DataFrame, kinds: Iterable[str] = (), extensions: Iterable[str] = ()) -> DataFrame:
    out = documents.where(F.col("kind").isin(*kinds)) if kinds else documents
    return out.where(F.col("file_ext").isin(*extensions)) if extensions else out


def signed(documents: DataFrame, wanted: bool) -> DataFrame:
    """An unknown signature counts as none."""
    held = F.coalesce("has_signature", F.lit(False))
    return documents.where(held if wanted else ~held)


def in_jurisdictions(documents: DataFrame, fields: DataFrame, names: Iterable[str]) -> DataFrame:
    held = fields.where((F.col("name") == "jurisdiction") & F.col("value_text").isin(*names))
    return documents.join(held.select("document_id"), "document_id", "left_semi")


def signed_by(documents: DataFrame, entities: DataFrame, name: str) -> DataFrame:
    """A signer of that name, of a name that contains it, or whose name begins it."""
    wanted, norm = T.normalize_exact(name), T.normalize(F.col("value_norm"))
    alike = norm.contains(wanted) | F.lit(wanted).startswith(F.concat(norm, F.lit(" ")))
    held = entities.where((F.col("type") == "person") & (F.col("role") == "signer") & alike)
    return documents.join(held.select("document_id"), "document_id", "left_semi")


def with_party(documents: DataFrame, entities: DataFrame, units: DataFrame, name: str) -> DataFrame:
    """A person or organisation whose name contains the words, or one of the units that holds the phrase."""
    wanted = " ".join(T.split_words(name))
    words = F.concat_ws(" ", T.tokens(F.col("value_norm")))
    named = entities.where(F.col("type").isin("person", "organization") & words.contains(wanted)).select("document_id")
    from folio.operators.postings import with_phrase

    held = named.unionByName(with_phrase(units, name).select("document_id")).distinct()
    return documents.join(held, "document_id", "left_semi")


def dated(documents: DataFrame, fields: DataFrame, start: date | None, end: date | None, field: str = "any") -> DataFrame:
    """A date in the inclusive range; without bounds the field must exist."""
    held = fields.where(F.col("name").isin(*DATE_FIELDS) if field == "any" else F.col("name") == field).where("value_date IS NOT NULL")
    if start:
        held = held.where(F.col("value_date") >= F.lit(start))
    if end:
        held = held.where(F.col("value_date") <= F.lit(end))
    return documents.join(held.select("document_id"), "document_id", "left_semi")


def of_amount(documents: DataFrame, fields: DataFrame, op: str, value: float, value2: float | None = None, currency: str | None = None) -> DataFrame:
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}")
    number = F.col("value_num")
    if op == "between":
        low, high = sorted((value, value if value2 is None else value2))
        hit = number.between(low, high)
    else:
        hit = {">": number > value, ">=": number >= value, "<": number < value, "<=": number <= value}[op]
    held = fields.where(F.col("name").isin(*AMOUNT_FIELDS) & hit)
    if currency:
        held = held.where(F.col("unit") == currency)
    return documents.join(held.select("document_id"), "document_id", "left_semi")


def with_clauses(documents: DataFrame, clauses: DataFrame, types: Iterable[str]) -> DataFrame:
    return documents.join(clauses.where(F.col("clause_type").isin(*types)).select("document_id"), "document_id", "left_semi")


def listing(documents: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest first; documents that are not indexed last; ties by id."""
    return documents.orderBy(F.desc_nulls_last("indexed_at"), "document_id").offset(offset).limit(limit)


def named_like(documents: DataFrame, part: str) -> DataFrame:
    return documents.where(F.col("filename").ilike(f"%{part}%"))
