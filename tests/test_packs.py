import json

import pytest

from folio.plans import packs as P


def test_packs(tmp_path):
    for name, pack in {
        "core": {"types": {"memo": {"memo": 2.0}}}, "legal": {"needs": ["business"], "concepts": {"secrecy": ["keep secret", "confidential"]}}, "business": {"types": {"policy": {"policy": 1.0}}},
        "a": {"needs": ["b"]}, "b": {"needs": ["a"]},
    }.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(pack))
    held = P.load(str(tmp_path))
    domain = P.merge(held, ["legal"])
    assert domain.packs == ("core", "business", "legal") and set(domain.types) == {"memo", "policy"}
    assert domain.concept_of("must keep secret all") == "secrecy" and domain.concept_of("x") is None
    for wrong in (["a"], ["none"]):
        with pytest.raises(ValueError):
            P.merge(held, wrong)
