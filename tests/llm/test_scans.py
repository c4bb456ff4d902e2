import random

from folio.llm.automaton import Trie
from folio.llm.scans import CONFUSIONS, LIMIT, _rules, fold, misread_number, page_number, repair_scans, token_keys, word_keys


def test_fold_is_unchanged_by_every_confusion():
    for pair in CONFUSIONS.split():
        written, meant = pair.split(":")
        for frame in ("x%sx", "n%so", "%s", "mi%s", "%sd"):
            assert fold(frame % written) == fold(frame % meant), pair


def test_automaton_equals_rewriting():
    vocabulary = ["manager", "corner", "customer", "clear", "dear", "house", "them", "then"]
    trie = Trie((w, 1.0) for w in vocabulary)

    def reached(word, left):
        out = {word}
        if left:
            for pair in CONFUSIONS.split():
                written, meant = pair.split(":")
                for i in range(len(word)):
                    if word.startswith(meant, i):
                        out |= reached(word[:i] + written + word[i + len(meant) :], left - 1)
        return out

    once = {w: reached(w, 1) for w in vocabulary}
    for token in set().union(*once.values()):
        found = {w for w, _, _, _ in trie.match(token, _rules(), 1)}
        assert found >= {w for w in vocabulary if token in once[w]}
        assert all(cost <= LIMIT for _, _, cost, _ in trie.match(token, _rules(), LIMIT))


def test_page_numbers():
    assert all(map(page_number, ("Page 3 of 12", "p. 4", "- 7 -", "[2]", "12/14", "iv", "9")))
    assert not any(map(page_number, ("713,746.88!", "within", "A", "(2024-01-02).")))
    assert misread_number("2o21") and misread_number("69l873") and not misread_number("2021") and not misread_number("1st")


def test_rows(spark):
    native = "the manager covers every customer house under the third-party terms and conditions\n" * 3
    scan = ["LUMEN REPORT\n\nThe manaqer covers thc custorner and the con-\nditions under third-\nparty terms in 2o21.\nEvery cust-\n\nPage 1 of 2", "LUMFN REPORT\nomer house covers terms\n\nPage 2 of 2"]
    rows = [("n", 1, "native", native, 0), ("d", 1, "ocr", scan[0], 0), ("d", 2, "ocr", scan[1], 0), ("d", 2, "ocr", scan[1], 0), ("e", 1, "ocr", None, 0), ("f", 1, "ocr", "", 0), (None, 1, "ocr", "x", 0), ("g", None, "ocr", "x", 0), ("h", 1, None, "x", 0), ("k", 1, "ocr", "the terms " * 20_000, 0)]
    df = spark.createDataFrame(rows, "document_id string, page int, kind string, text string, running int")
    out = {(r["document_id"], r["page"]): r for r in repair_scans(df).collect()}
    assert set(out) == {("d", 1), ("d", 2), ("e", 1), ("f", 1), ("k", 1)}
    problems = {(p["line_no"], p["problem"]) for p in out["d", 1]["problems"]}
    assert problems == {(1, "running"), (3, "misread"), (3, "hyphen"), (5, "misread"), (6, "hyphen"), (8, "running")}
    assert {(p["line_no"], p["problem"]) for p in out["d", 2]["problems"]} == {(1, "running"), (4, "running")}
    assert out["d", 1]["text"] == "The manager covers the customer and the conditions under third-party terms in 2021. Every customer"
    assert out["d", 2]["text"] == "house covers terms" and out["e", 1]["text"] == "" and out["k", 1]["problems"] == []
    assert repair_scans(df.limit(0)).count() == 0
    assert repair_scans(df.where("kind = 'ocr'")).count() == 5


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_all_words_one_edit_away_are_retrieved():
    r = random.Random(4)
    vocabulary = sorted({"".join(r.choice("abc") for _ in range(r.randint(4, 9))) for _ in range(900)})
    fore, back = Trie((w, 1.0) for w in vocabulary), Trie((w[::-1], 1.0) for w in vocabulary)
    keys = {w: set(word_keys(w)) for w in vocabulary}
    for _ in range(300):
        token = "".join(r.choice("abcd") for _ in range(r.randint(5, 9)))
        near = {w for w in vocabulary if distance(token, w) == 1}
        half = len(token) // 2
        found = {w for w, _ in fore.near(token, half)} | {w[::-1] for w, _ in back.near(token[::-1], len(token) - half)}
        assert found == near
        assert all(keys[w] & set(token_keys(token)) for w in near)


WORDS = ("every", "about", "between", "house")


def test_errors_outside_the_table_and_deep_furniture(spark):
    native = "the document shows every agreement between customers and managers of the house about terms\n" * 20
    head = "ACME REPORT\nFINAL VERSION\nINTERNAL COPY\nNORTHERN BRANCH"
    scan = [f"{head}\nThe documnt shows {w} aqreement of\nmanagers {w} documeent about docurnent\nterms for {w} custqmers.\nPage {n} of 4" for n, w in enumerate(WORDS, 1)]
    rows = [("n", 1, "native", native)] + [("d", n, "ocr", t) for n, t in enumerate(scan, 1)]
    out = repair_scans(spark.createDataFrame(rows, "document_id string, page int, kind string, text string")).collect()
    assert len(out) == 4
    for r in out:
        w = WORDS[r["page"] - 1]
        assert r["text"] == f"The document shows {w} agreement of managers {w} document about document terms for {w} customers."
        assert [p["line_no"] for p in r["problems"] if p["problem"] == "running"] == [1, 2, 3, 4, 8]
        assert [p["line_no"] for p in r["problems"] if p["problem"] == "misread"] == [5, 6, 7]


def test_pages_of_nothing_else_end(spark):
    copy = "\n".join(f"{w} line of a copied page" for w in ("one two three four five six seven eight nine ten".split()))
    rows = [("d", n, "ocr", copy) for n in (1, 2)] + [("d", 3, "ocr", "")]
    out = repair_scans(spark.createDataFrame(rows, "document_id string, page int, kind string, text string")).collect()
    assert {r["page"]: [p["line_no"] for p in r["problems"]] for r in out} == {1: list(range(1, 11)), 2: list(range(1, 11)), 3: []}
