"""Grounded answers: evidence, the extractive answer, and the check of a generated one."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.extract import sentences
from folio.functions.text import STOPWORDS, split_words

MOST_EVIDENCE, MOST_SENTENCES, LEAST_CHARS = 12, 3, 12
#: Sentences that give orders to a reader of the evidence are withheld (fixed patterns).
ORDERS = re.compile(r"(?i)\b(?:ignore|disregard|forget) (?:all |any |the )?(?:previous|prior|above|other)|\byou (?:are|must) now\b|\bsystem prompt\b|\breveal (?:your|the) (?:instructions|prompt)")


def stems(text: str) -> set[str]:
    """Content words cut to five characters: enough to meet inflected forms."""
    return {w[:5] for w in split_words(text) if w not in STOPWORDS and len(w) > 2}


def collect_evidence(results: list[dict]) -> tuple[list[dict], list[tuple[str, int, int]]]:
    """Evidence items E1.. of the first five results without repetitions, and what was withheld."""
    items, withheld, seen = [], [], set()
    for result in results[:5]:
        for e in result.get("evidence", ()):
            key = (result["document_id"], e["page"], e["char_start"])
            if key in seen or len(items) == MOST_EVIDENCE:
                continue
            seen.add(key)
            spans = [(a, b) for a, b in sentences(e["text"]) if ORDERS.search(e["text"][a:b])]
            identifier = f"E{len(items) + 1}"
            withheld += [(identifier, a, b) for a, b in spans]
            items.append({**e, "id": identifier, "document_id": result["document_id"], "withheld": spans})
    return items, withheld


def extractive(question: str, items: list[dict]) -> dict:
    """Up to three sentences of the evidence that share most stems with the question; none: abstained."""
    asked, found = stems(question), []
    for rank, item in enumerate(items):
        for a, b in sentences(item["text"]):
            if b - a < LEAST_CHARS or any(a < e and s < b for s, e in item.get("withheld", ())):
                continue
            hits = len(asked & stems(item["text"][a:b]))
            if hits:
                found.append((-hits, rank, a, b, item))
    found.sort(key=lambda x: x[:3])
    chosen = [{"text": i["text"][a:b], "citations": [i["id"]], "span": [i["char_start"] + a, i["char_start"] + b]} for _, _, a, b, i in found[:MOST_SENTENCES]]
    return {"provider": "extractive", "status": "answered" if chosen else "abstained", "sentences": chosen}


def counted_noun(question: str) -> str | None:
    """X of a question "how many X"."""
    m = re.search(r"(?i)\bhow many ([a-z][a-z-]*)", question)
    return m[1].lower() if m else None


def stated_figure(text: Column, noun: str) -> Column:
    """The number that a text gives for a noun, before or after it; null where there is none."""
    root = re.escape(noun[:-1] if noun.endswith("s") and len(noun) > 3 else noun)
    number = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
    after, before = rf"(?i)\b{root}\w*\b[^.\n0-9]{{0,40}}?{number}", rf"(?i)\(?{number}\)?\s+(?:[a-z]+\s+){{0,2}}{root}\w*\b"
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (after, before)])


def verify(answer: list[dict], items: list[dict], most: int = 8, chars: int = 600) -> tuple[list[dict], list[tuple[dict, str]]]:
    """Sentences of a generated answer that their citations support, and the dropped ones with the reason."""
    by, kept, dropped = {i["id"]: i for i in items}, [], []
    for s in answer:
        source = " ".join(by[c]["text"] for c in s.get("citations", ()) if c in by)
        own = stems(s["text"])
        numbers = re.findall(r"\d[\d.,]*\d|\d", s["text"])
        quotes = re.findall(r"[\"“]([^\"”]+)[\"”]", s["text"])
        if not s.get("citations") or any(c not in by for c in s["citations"]):
            reason = "citation"
        elif any(n not in source for n in numbers):
            reason = "number"
        elif any(" ".join(split_words(q)) not in " ".join(split_words(source)) for q in quotes):
            reason = "quote"
        elif own and len(own & stems(source)) < 0.6 * len(own):
            reason = "support"
        elif len(kept) >= most or len(s["text"]) > chars:
            reason = "length"
        else:
            kept.append(s)
            continue
        dropped.append((s, reason))
    return kept, dropped
