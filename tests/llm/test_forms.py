from folio.llm.automaton import Trie
from folio.llm.forms import COMBINING, HIDDEN, LOOKALIKE, WIDTH, _rules, consistent_text, normalize, skeleton, suspect


def test_automaton_reads_all_forms_at_no_cost():
    trie = Trie([("employee", 5.0), ("file", 3.0), ("café", 2.0), ("дом", 1.0)])
    for token, word in (("emрloyее", "employee"), ("ﬁle", "file"), ("ｆｉｌｅ", "file"), ("café", "café"), ("саfе́", "café"), ("em​ploy­ee", "employee"), ("дoм", "дом"), ("EМPLOYEE", "employee")):
        found = trie.match(token, _rules(), 0)
        assert [w for w, _, cost, _ in found if cost == 0] == [word], token
        assert skeleton(token) == skeleton(word)
    assert trie.match("filer", _rules(), 0) == []


def test_table_without_known_words():
    text, forms = normalize("Тhe ﬁnal café was​ ｏｋ", {})
    assert (text, forms) == ("The final café was ok", ["combining", "invisible", "lookalike", "space", "width"])
    for fine in ("“quoted” – ½ № … β release", "Дом и дача", "με το Hulokis office"):
        assert normalize(fine, {}) == (fine, [])


def test_rows(spark):
    rows = [(1, "the employee file", "x"), (2, "the emрloyее file", "x"), (3, None, "x"), (4, "", "x"), (2, "the emрloyее file", "x"), (None, "a b", "x"), (5, "the employee " * 20_000 + "ﬁle", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, forms string")
    out = [tuple(r) for r in consistent_text(df).collect()]
    assert len(out) == 7
    by = {i: (t, f) for i, t, f in out}
    assert by[1] == by[2][:1] + ([],) and by[2] == ("the employee file", ["lookalike"])
    assert by[3] == (None, []) and by[4] == ("", []) and by[None] == ("a b", ["space"]) and by[5][0].endswith("file") and by[5][1] == ["width"]
    assert {r["doc_id"] for r in consistent_text(df, only_changed=True).collect()} == {2, None, 5}
    assert consistent_text(df.limit(0)).count() == 0


def test_hint_sees_all_marks():
    assert suspect("plain がく") and suspect("aἀ") and suspect("aꙋ") and not suspect("plain") and not suspect("ἀνήρ")


def test_forms_are_those_of_the_accepted_path(spark, monkeypatch):
    trie = Trie([("employee", 5.0), ("file", 3.0), ("café", 2.0)])
    marks = {t: trie.match(t, _rules(), 0)[0][3] for t in ("emрloyее", "ﬁle", "ﬁ\u200ble", "cafe\u0301", "саfе\u0301", "ｆile", "EMPLOYEE")}
    assert marks == {"emрloyее": LOOKALIKE, "ﬁle": WIDTH, "ﬁ\u200ble": WIDTH | HIDDEN, "cafe\u0301": COMBINING, "саfе\u0301": COMBINING | LOOKALIKE, "ｆile": WIDTH, "EMPLOYEE": 0}
    # What the automaton says decides: another path gives other forms and another text.
    assert normalize("the emрloyее", {"emрloyее": ("other", WIDTH)}) == ("the other", ["width"])
    rows = spark.createDataFrame([(1, "the employee file"), (2, "an employee"), (3, "the emрloyее")], "doc_id long, text string")
    assert [tuple(r) for r in consistent_text(rows, only_changed=True).collect()] == [(3, "the employee", ["lookalike"])]
    monkeypatch.setattr("folio.llm.forms._read", lambda words: lambda token, weight: [(token, "nothing", HIDDEN)])
    assert [tuple(r) for r in consistent_text(rows, only_changed=True).collect()] == [(3, "the nothing", ["invisible"])]
