import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm.split import LEVELS, atoms, rejoined, split_text, split_units


def boundary_of(text, size):
    for name, separator in LEVELS:
        if all(len(part) <= size for part in separator.split(text)):
            return name
    return "none"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab.!? \ńé", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_pieces_cover_the_text(text, most, overlap):
    level, pieces = split_text(text, most, overlap)
    assert all(b - a <= most for a, b, _ in pieces)
    assert "".join(text[a + over : b] for a, b, over in pieces) == text
    assert all(over <= overlap for _, _, over in pieces)
    assert level == boundary_of(text, most - overlap)


def test_levels():
    assert atoms("aaaa\n\nbb b", 4) == ("paragraph", {6: 4, 4: 0}) and atoms("aa bb", 3) == ("word", {3: 1})
    assert boundary_of("aaa\n\nbbb", 3) == "paragraph"
    assert boundary_of("aaa\nbbb", 3) == "line"
    assert boundary_of("aa. bbb", 3) == "sentence"
    assert boundary_of("aa bbb", 3) == "word"
    assert boundary_of("aabbb", 3) == "none"


def test_a_limit_of_one_character_ends():
    text = "e\u0301e\u0301\u0301"
    assert [text[a:b] for a, b, _ in split_text(text, 1, 0)[1]] == list(text)


def test_weak_boundaries_are_merged_first():
    text = "aaaa bbbb.\n\ncccc dddd."
    level, pieces = split_text(text, 14, 0)
    assert [text[a:b] for a, b, _ in pieces] == ["aaaa bbbb.\n\n", "cccc dddd."]


def test_units(spark):
    long = "ab cd. " * 30_000
    rows = [
        ("u1", "passage", "aa bb cc dd ee ff", 1, "x"), ("u1", "passage", "aa bb cc dd ee ff", 2, "x"), ("u2", "passage", "short", 1, "x"), ("u3", "passage", None, 1, "x"),
        ("u4", None, "aa bb cc dd ee ff", 1, "x"), (None, "passage", "aa bb cc dd ee ff", 1, "x"), ("u5", "other", "aa bb cc dd ee ff", 1, "x"), ("u6", "passage", long, None, "x"), ("u7", "passage", "", 1, "x"),
    ]
    units = spark.createDataFrame(rows, "unit_id string, unit_type string, text string, n int, max_chars string").selectExpr("*", "timestamp_seconds(n) as stored_at")
    limits = spark.createDataFrame([("passage", 10, 2), ("passage", 10, 2)], "unit_type string, max_chars int, overlap_chars int")
    out = split_units(units, limits)
    found = {(r["unit_id"], r["piece_no"]): r for r in out.collect()}
    assert {u for u, _ in found} == {"u1", "u6"} and len(found) == out.count()
    pieces = [found["u6", n] for n in range(1, sum(u == "u6" for u, _ in found) + 1)]
    assert "".join(p["text"][p["overlap"] :] for p in pieces) == long
    assert all(len(p["text"]) <= 10 and long[p["char_start"] : p["char_end"]] == p["text"] for p in pieces)
    checked = [tuple(r) for r in rejoined(out, units, limits).select("unit_id", "fits", "overlaps").collect()]
    assert sorted(checked) == [("u1", True, True), ("u6", True, True)]
    whole = {r["unit_id"]: r["whole"] for r in rejoined(out, units, limits).collect()}
    assert whole == {"u1": hashlib.md5(b"aa bb cc dd ee ff").hexdigest(), "u6": hashlib.md5(long.encode()).hexdigest()}
    assert all(r["whole"] != whole[r["unit_id"]] for r in rejoined(out.where("piece_no <> 2"), units, limits).collect())
    assert split_units(units.limit(0), limits).count() == 0 and split_units(units, limits.limit(0)).count() == 0
