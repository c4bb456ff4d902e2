"""Evaluation: golden questions against a target, scores, gates and comparison of two runs."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Golden:
    id: str
    tenant: str
    question: str
    category: str = "search"
    relevant: dict[str, int] = field(default_factory=dict)
    exact: bool = False
    unanswerable: bool = False
    value: float | None = None


#: A target answers (tenant, question) with names in order, and a number where it computed one.
Target = Callable[[str, str], tuple[list[str], float | None]]


def score(golden: Golden, names: list[str], value: float | None, k: int = 10) -> dict:
    """Measures of one question; gains are 2^grade - 1."""
    grades = [golden.relevant.get(n, 0) for n in names]
    ideal = sorted(golden.relevant.values(), reverse=True)

    def dcg(g: list[int]) -> float:
        return sum((2**x - 1) / math.log2(i + 2) for i, x in enumerate(g[:k]))

    found = sum(g > 0 for g in grades[:k])
    return {
        "id": golden.id, "category": golden.category, "precision_at_5": sum(g > 0 for g in grades[:5]) / 5, "recall_at_k": found / len(ideal) if ideal else None,
        "reciprocal_rank": next((1 / (i + 1) for i, g in enumerate(grades) if g > 0), 0.0) if ideal else None, "ndcg": dcg(grades) / dcg(ideal) if ideal else None,
        "exact_recall": float(set(golden.relevant) <= set(names)) if golden.exact else None, "computed": None if golden.value is None else float(value is not None and abs(value - golden.value) <= 0.01),
        "false_positive": float(bool(names)) if golden.unanswerable else None,
    }


def run(questions: list[Golden], target: Target, tenants: list[str]) -> tuple[list[dict], int]:
    """Scores of all questions, and how many results of a question were shown to another tenant."""
    scores, leaked = [], 0
    for q in questions:
        names, value = target(q.tenant, q.question)
        scores.append(score(q, names, value))
        for other in tenants:
            if other != q.tenant:
                leaked += len(set(target(other, q.question)[0]) & set(q.relevant))
    return scores, leaked


def summary(scores: list[dict]) -> dict[str, float]:
    """Means over the questions that have a measure."""
    keys = [k for k in (scores[0] if scores else {}) if k not in ("id", "category")]
    held = {k: [s[k] for s in scores if s[k] is not None] for k in keys}
    return {k: round(sum(v) / len(v), 4) for k, v in held.items() if v}


def failed_gates(means: dict[str, float], least: dict[str, float], most: dict[str, float]) -> list[str]:
    return [k for k, v in least.items() if means.get(k, 0.0) < v] + [k for k, v in most.items() if means.get(k, 0.0) > v]


def regressions(before: list[dict], after: list[dict], measure: str = "reciprocal_rank") -> list[str]:
    old = {s["id"]: s[measure] for s in before}
    return [s["id"] for s in after if s[measure] is not None and (old.get(s["id"]) or 0.0) > s[measure] + 1e-9]
