"""Extraction: pure functions from a page's text to facts with spans, and one Arrow stage that runs them.

Every fact is (start, end) into the page's text, so text[start:end] is its value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.plans.plan import CURRENCY, MONTHS, TIMES

# Cues and patterns.
DATE_ROLES = {"issued": "issue_date", "dated": "issue_date", "invoice date": "issue_date", "effective": "effective_date", "commence": "effective_date", "expire": "expiry_date", "terminate": "expiry_date", "until": "expiry_date", "due": "due_date", "payable": "due_date", "signed": "signature_date"}
AMOUNT_ROLES = {"total": "total_amount", "amount due": "total_amount", "balance": "total_amount", "tax": "tax_amount", "vat": "tax_amount", "salary": "salary", "per month": "periodic_amount", "monthly": "periodic_amount"}
IDENTIFIER_CUES = {"invoice": "invoice_number", "purchase order": "po_number", "order": "po_number", "reference": "reference", "contract": "contract_number", "ticket": "ticket_number"}
PERSON_CUES = ("signed by", "contact", "attention", "prepared by", "approved by", "represented by", "held by", "mr.", "mrs.", "ms.", "dr.")
LEGAL_FORM = r"(?:Inc|Corp|Corporation|Co|Company|Ltd|Limited|LLC|PLC|GmbH|GesmbH|AG|A\.G\.|SA|BV|NV|Incorporated|Aktiengesellschaft)"
CLAUSE_WORDS = {
    "termination": "termination", "term and": "term", "payment": "payment", "fees": "payment", "warranty": "warranty", "confidential": "confidentiality", "governing law": "governing_law", "dispute": "dispute_resolution",
    "liability": "liability", "notice": "notices", "insurance": "insurance", "assignment": "assignment", "renewal": "renewal",
}
JURISDICTIONS = ("england and wales", "united kingdom", "united states", "new york", "delaware", "california", "germany", "france", "spain", "italy", "netherlands", "portugal", "greece", "switzerland", "austria", "belgium", "ireland", "scotland", "singapore", "ontario")

_MONTH = "|".join(sorted((m.capitalize() for m in MONTHS), key=len, reverse=True))
_DATES = (
    (re.compile(r"\b(\d{4})-(\d{2})-(\d{2})\b"), "ymd", 0.95), (re.compile(rf"\b(\d{{1,2}})(?:st|nd|rd|th)? ({_MONTH})\.?,? (\d{{4}})\b"), "dMy", 0.95), (re.compile(rf"\b({_MONTH})\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})\b"), "Mdy", 0.95),
    (re.compile(r"\b(\d{1,2})[./-](\d{1,2})[./-](\d{4})\b"), "dmy", 0.8), (re.compile(rf"\b({_MONTH}) (\d{{4}})\b"), "My", 0.6),
)
_AMOUNT = re.compile(r"(?:(?P<before>[€$£]|\b(?:EUR|USD|GBP|CHF)) ?)?(?P<n>\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)(?: ?(?P<times>k|m|bn|thousand|million|billion)\b)?(?: ?(?P<after>EUR|USD|GBP|CHF|euros?|dollars?)\b)?")
_NAME = r"(?:[A-ZÀ-Þ][\w'’.-]*)(?: (?:[A-ZÀ-Þ][\w'’.-]*)){1,3}"
_ORGANIZATION = re.compile(rf"\b(?:[A-ZÀ-Þ][\w&'’-]*,? ){{1,6}}{LEGAL_FORM}\b\.?")
_BETWEEN = re.compile(rf"\bbetween ({_NAME}) and ({_NAME})")
_CLAUSE = re.compile(r"(?m)^(?:(?P<ref>\d{1,2}(?:\.\d{1,2})*)[.)]? +(?P<head>[A-Z][^\n]{2,80})|(?P<title>[A-Z][A-Za-z ]{3,60}))$")
_CONTACT = re.compile(r"(?P<email>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)|(?P<phone>(?<![\w/-])\+?\(?\d[\d ()-]{6,18}\d(?![\w/-]))")
_SENTENCE = re.compile(r"[^.!?;\n]+(?:[.!?;]+|$|(?=\n))")
_LABEL = re.compile(r"(?m)^([A-Z][\w /-]{1,38}): +(\S[^\n]*)$")
_STOP = re.compile(r"[.\n]")
# Sentences that state a clause without a heading: type, cue, whether the sentence begins before the cue.
_STATED = (
    ("governing_law", re.compile(r"(?i)\bgoverned\s+by\s+the\s+laws?\s+of\b"), True), ("governing_law", re.compile(r"(?i)\bgoverning\s+law\s*:"), False),
    ("termination", re.compile(r"(?i)\b(?:may|shall|can)\s+(?:terminate|end\s+(?:the|this)\s+(?:employment|agreement|contract|lease|engagement))\b"), True),
)


def _cue(text: str, start: int, roles: dict[str, str], reach: int) -> str | None:
    """The role whose cue stands nearest before a position, within the same clause."""
    before = text[max(0, start - reach) : start].lower()
    before = re.split(r"[.;\n]", before)[-1]
    found = [(before.rfind(cue) + len(cue), len(cue), role) for cue, role in roles.items() if cue in before]
    return max(found)[2] if found else None


def find_dates(text: str) -> list[dict]:
    found: list[dict] = []
    for pattern, order, confidence in _DATES:
        for m in pattern.finditer(text):
            if any(m.start() < f["end"] and f["start"] < m.end() for f in found):
                continue
            a, b, c = (*m.groups(), "1")[:3] if order != "My" else ("1", *m.groups())
            sure = confidence
            if order == "ymd":
                y, mo, d = int(a), int(b), int(c)
            elif order == "dMy" or order == "My":
                y, mo, d = int(c), MONTHS[b.lower()], int(a)
            elif order == "Mdy":
                y, mo, d = int(c), MONTHS[a.lower()], int(b)
            else:
                y, mo, d = int(c), int(b), int(a)
                if mo > 12:
                    mo, d = d, mo
                elif d <= 12 and d != mo:
                    sure = 0.6  # day first when nothing tells
            try:
                day = date(y, mo, d)
            except ValueError:
                continue
            found.append({"start": m.start(), "end": m.end(), "name": _cue(text, m.start(), DATE_ROLES, 70) or "date", "value": day.isoformat(), "confidence": sure})
    return sorted(found, key=lambda f: f["start"])


def find_amounts(text: str) -> list[dict]:
    """Numbers with a currency; others are no amounts."""
    found = []
    for m in _AMOUNT.finditer(text):
        currency = CURRENCY.get((m["before"] or m["after"] or "").lower() or "-")
        if currency:
            number = float(m["n"].replace(",", "")) * TIMES.get(m["times"] or "", 1.0)
            found.append({"start": m.start(), "end": m.end(), "name": _cue(text, m.start(), AMOUNT_ROLES, 60) or "amount", "value": f"{number:.2f}", "unit": currency, "confidence": 0.9})
    return found


def find_identifiers(text: str) -> list[dict]:
    found: dict[int, dict] = {}
    for cue in sorted(IDENTIFIER_CUES, key=len, reverse=True):
        for m in re.finditer(rf"(?i)\b{cue}(?: (?:no\.?|number|#))?:? *#? *([A-Z0-9][\w/-]*\d[\w/-]*)", text):
            found.setdefault(m.start(1), {"start": m.start(1), "end": m.end(1), "name": IDENTIFIER_CUES[cue], "value": m[1], "confidence": 0.9})
    return sorted(found.values(), key=lambda f: f["start"])


def find_people(text: str) -> list[dict]:
    found = []
    for cue in PERSON_CUES:
        for m in re.finditer(rf"(?i:\b{re.escape(cue)}):? ({_NAME})", text):
            name = m[1].rstrip(".,")
            role = "signer" if cue == "signed by" else "contact"
            found.append({"start": m.start(1), "end": m.start(1) + len(name), "name": role, "value": name, "confidence": 0.85})
    return sorted({f["start"]: f for f in found}.values(), key=lambda f: f["start"])


def find_organizations(text: str) -> list[dict]:
    found = {m.start(): {"start": m.start(), "end": m.end(), "name": "party", "value": m.group(), "confidence": 0.7} for m in _ORGANIZATION.finditer(text)}
    for m in _BETWEEN.finditer(text):
        for k in (1, 2):
            if not any(f["start"] < m.end(k) and m.start(k) < f["end"] for f in found.values()):
                found[m.start(k)] = {"start": m.start(k), "end": m.end(k), "name": "party", "value": m[k], "confidence": 0.8}
    return sorted(found.values(), key=lambda f: f["start"])


def find_jurisdictions(text: str) -> list[dict]:
    """Only names of the gazetteer, and only after a cue of law; the longest name wins."""
    names = "|".join(sorted(JURISDICTIONS, key=len, reverse=True))
    pattern = re.compile(rf"(?i)\b(?:laws? of|courts? of|governed by|jurisdiction of)(?: the)?(?: state of| laws of)? ({names})\b")
    return [{"start": m.start(1), "end": m.end(1), "name": "jurisdiction", "value": m[1], "confidence": 0.9} for m in pattern.finditer(text)]


def find_contacts(text: str) -> list[dict]:
    found = []
    for m in _CONTACT.finditer(text):
        kind = m.lastgroup
        if kind == "phone" and (not 8 <= sum(c.isdigit() for c in m.group()) <= 15 or any(p.search(m.group()) for p, _, _ in _DATES)):
            continue
        found.append({"start": m.start(), "end": m.end(), "name": kind, "value": m.group(), "confidence": 0.99 if kind == "email" else 0.7})
    return found


def find_clauses(text: str) -> list[dict]:
    """Headed clauses up to the next head, and sentences that state a governing law or a right to terminate.
    The heading tells the type, else the opening of the body, else the rest of it."""
    heads = list(_CLAUSE.finditer(text))
    found = []
    for k, m in enumerate(heads):
        stop = heads[k + 1].start() if k + 1 < len(heads) else len(text)
        body = text[m.end() : stop].rstrip()
        head, low = (m["head"] or m["title"]).lower(), body.lower()
        kind, sure = next(((c, sure) for part, sure in ((head, 0.95), (low[:240], 0.75), (low, 0.75)) for w, c in CLAUSE_WORDS.items() if w in part), (None, 0.0))
        if kind and body.strip():
            found.append({"start": m.start(), "end": m.end() + len(body), "name": kind, "value": text[m.start() : m.end() + len(body)], "unit": m["ref"], "confidence": sure})
    headed = list(found)
    for kind, cue, before in _STATED:
        end = 0
        for m in cue.finditer(text):
            if m.start() < end:
                continue
            start = max(end, text.rfind(".", end, m.start()) + 1, text.rfind("\n", end, m.start()) + 1) if before else m.start()
            stop = _STOP.search(text, m.end())
            end = stop.end() if stop else len(text)
            value = text[start:end].strip()
            start += len(text[start:end]) - len(text[start:end].lstrip())
            if not any(f["name"] == kind and f["start"] <= start < f["end"] for f in headed):
                found.append({"start": start, "end": start + len(value), "name": kind, "value": value, "confidence": 0.7})
    return sorted(found, key=lambda f: f["start"])


def find_relations(text: str) -> list[dict]:
    """Label: value lines."""
    return [{"start": m.start(2), "end": m.end(2), "name": m[1].strip().lower().replace(" ", "_"), "value": m[2], "confidence": 0.8} for m in _LABEL.finditer(text)]


def pattern_relations(text: str, patterns: dict[str, str]) -> list[dict]:
    """Relations that a domain's patterns state, sentence by sentence: name -> pattern with the groups ``subject`` and ``object``;
    further groups are qualifiers. The span is the sentence's."""
    compiled = {name: re.compile(p) for name, p in patterns.items()}
    found = []
    for a, b in sentences(text):
        for name, p in compiled.items():
            for m in p.finditer(text, a, b):
                groups = {k: v.strip() for k, v in m.groupdict().items() if v}
                if "subject" in groups and "object" in groups:
                    found.append({"start": a, "end": b, "name": name, "subject": groups.pop("subject"), "object": groups.pop("object"), "qualifiers": groups, "confidence": 0.75})
    return found


def derived_relations(fields: DataFrame, entities: DataFrame) -> DataFrame:
    """document_id, subject, name, object: signed (a signer), party_to (an organisation) and governed_by (a jurisdiction), from
    what was extracted of a document."""
    people = entities.where("type = 'person' AND role = 'signer'").select("document_id", F.col("value").alias("subject"), F.lit("signed").alias("name"), F.col("document_id").alias("object"))
    parties = entities.where("type = 'organization'").select("document_id", F.col("value").alias("subject"), F.lit("party_to").alias("name"), F.col("document_id").alias("object"))
    law = fields.where("name = 'jurisdiction' AND value_text IS NOT NULL").select("document_id", F.col("document_id").alias("subject"), F.lit("governed_by").alias("name"), F.col("value_text").alias("object"))
    return people.unionByName(parties).unionByName(law).distinct()


def sentences(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _SENTENCE.finditer(text):
        part = m.group()
        a = m.start() + len(part) - len(part.lstrip())
        if part.strip():
            found.append((a, m.start() + len(part.rstrip())))
    return found


FINDERS = {
    "date": find_dates, "amount": find_amounts, "identifier": find_identifiers, "person": find_people, "organization": find_organizations, "jurisdiction": find_jurisdictions, "contact": find_contacts, "clause": find_clauses,
    "relation": find_relations,
}
FACTS = "document_id string, page int, kind string, name string, value string, unit string, char_start int, char_end int, confidence double"


def analyze(pages: DataFrame, asked: tuple[str, ...] = tuple(FINDERS)) -> DataFrame:
    """All facts of pages (document_id, page, text), or those of some kinds, in one Arrow stage; null text has none."""
    finders = {kind: FINDERS[kind] for kind in asked}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64())
        names = [c.split()[0] for c in FACTS.split(", ")]
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for document, page, text in zip(*(c.to_pylist() for c in batch.columns)):
                for kind, find in finders.items():
                    for f in find(text or ""):
                        for column, value in zip(out, (document, page, kind, f["name"], f["value"], f.get("unit"), f["start"], f["end"], f["confidence"])):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return pages.select("document_id", "page", "text").mapInArrow(run, FACTS)


# Keywords of document types with their weights; the title counts more.
TYPE_WORDS = {
    "invoice": {"invoice": 2.0, "amount due": 1.5, "bill to": 1.0}, "purchase_order": {"purchase order": 2.5, "ship to": 1.0, "qty": 0.5}, "nda": {"nda": 2.5, "confidential information": 2.0, "non-disclosure": 2.5},
    "lease_agreement": {"lease agreement": 3.0, "landlord": 1.0, "tenant": 1.0, "rent": 0.8}, "service_agreement": {"service agreement": 3.0, "services": 0.5}, "memo": {"memo": 2.0, "note on": 1.5},
    "letter": {"dear": 1.5, "yours sincerely": 1.5}, "report": {"report": 1.0, "findings": 1.0, "summary": 0.8}, "policy": {"policy": 1.5, "employees must": 1.5},
}


def classify(title: str, text: str) -> tuple[str, float, str]:
    """Type, confidence and method: weights of keywords in the whole text, those in the title counting twice."""
    low, head = text.lower(), title.lower()
    scores = sorted(((sum(w * (min(3, low.count(k)) + 2 * (k in head)) for k, w in words.items()), t) for t, words in TYPE_WORDS.items()), reverse=True)
    (top, kind), (second, _) = scores[:2]
    if top >= 2.5:
        return kind, round(max(0.35, min(0.98, 0.55 + 0.08 * top) * (1 - 0.45 * second / top)), 6), "rules"
    return (kind, 0.4, "rules_weak") if top > 0 else ("other", 0.5, "none")


def classified(title: Column, text: Column) -> Column:
    """classify() as a column: struct(doc_type, confidence, method) of a document's title and whole text."""
    low, head = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    scores = []
    for kind, words in TYPE_WORDS.items():
        score = F.lit(0.0)
        for k, w in words.items():
            times = (F.length(low) - F.length(F.replace(low, F.lit(k), F.lit("")))) / len(k)
            score = score + w * (F.least(F.lit(3.0), times) + F.when(head.contains(k), 2.0).otherwise(0.0))
        scores.append(F.struct(score.alias("score"), F.lit(kind).alias("kind")))
    ranked = F.sort_array(F.array(*scores), asc=False)
    top, second = ranked[0]["score"], ranked[1]["score"]
    sure = F.round(F.greatest(F.lit(0.35), F.least(F.lit(0.98), 0.55 + 0.08 * top) * (1 - 0.45 * F.try_divide(second, top))), 6)
    weak = F.when(top > 0, F.struct(ranked[0]["kind"].alias("doc_type"), F.lit(0.4).alias("confidence"), F.lit("rules_weak").alias("method")))
    none = F.struct(F.lit("other").alias("doc_type"), F.lit(0.5).alias("confidence"), F.lit("none").alias("method"))
    return F.when(top >= 2.5, F.struct(ranked[0]["kind"].alias("doc_type"), sure.alias("confidence"), F.lit("rules").alias("method"))).otherwise(F.coalesce(weak, none))
