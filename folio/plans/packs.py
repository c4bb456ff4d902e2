"""Domain packs: knowledge as data. A pack is a JSON file {name, needs, types, concepts, cues}; the domain
merges the core pack and the chosen ones after the packs they need."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Domain:
    packs: tuple[str, ...] = ()
    types: dict[str, dict[str, float]] = field(default_factory=dict)
    concepts: dict[str, tuple[str, ...]] = field(default_factory=dict)
    cues: dict[str, str] = field(default_factory=dict)

    def type_terms(self) -> dict[str, str]:
        """Ways to name a document type in a question: its name in words, singular and plural."""
        return {form: kind for kind in self.types for form in (kind.replace("_", " "), f"{kind.replace('_', ' ')}s")}

    def concept_of(self, question: str) -> str | None:
        """The concept whose longest way of saying stands in a normalized question."""
        found = [(len(way), name) for name, ways in self.concepts.items() for way in ways if way in question]
        return max(found)[1] if found else None


def load(folder: str) -> dict[str, dict]:
    return {p.stem: json.loads(p.read_text()) for p in sorted(Path(folder).glob("*.json"))}


def ordered(packs: dict[str, dict], chosen: list[str]) -> list[str]:
    """The chosen packs and all that they need, each after its needs; a circle is an error."""
    done: list[str] = []

    def visit(name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise ValueError("packs need each other: " + " -> ".join((*above, name)))
        if name not in packs:
            raise ValueError(f"no pack {name!r}")
        if name not in done:
            for need in packs[name].get("needs", ()):
                visit(need, (*above, name))
            done.append(name)

    for name in ["core", *chosen] if "core" in packs else chosen:
        visit(name, ())
    return done


def merge(packs: dict[str, dict], chosen: list[str]) -> Domain:
    """Later packs add to earlier ones and replace entries of the same name."""
    names = ordered(packs, chosen)
    types: dict[str, dict[str, float]] = {}
    concepts: dict[str, tuple[str, ...]] = {}
    cues: dict[str, str] = {}
    for name in names:
        types |= packs[name].get("types", {})
        concepts |= {k: tuple(sorted(v, key=len, reverse=True)) for k, v in packs[name].get("concepts", {}).items()}
        cues |= packs[name].get("cues", {})
    return Domain(tuple(names), types, concepts, cues)
