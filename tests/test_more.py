from folio.functions.chunks import chunk_pages, page_units, passages
from folio.functions.stem import stem, with_stems
from folio.operators import evaluate as V


def test_stems():
    for word, wanted in (
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"),
        ("conditional", "condit"), ("rationalization", "ration"), ("generously", "generous"), ("skies", "sky"), ("dying", "die"), ("happily", "happili"), ("communication", "communic"), ("consignment", "consign"), ("knightly", "knight"),
    ):
        assert stem(word) == wanted, (word, stem(word))


def test_stems_of_postings(spark):
    df = spark.createDataFrame([("invoices", "u"), ("invoice", "v"), (None, "w")], "term string, unit_id string")
    assert {tuple(r) for r in with_stems(df).select("unit_id", "stem").collect()} == {("u", "invoic"), ("v", "invoic")}


def test_units(spark):
    text = "Head line\n\n" + "This is a sentence of some length that goes on. " * 60 + "\n\nno | item | qty\n1 | lamp | 3\n2 | desk | 4\n\nThe end."
    units = page_units(text)
    assert all(text[a:b] == t for _, t, _, a, b in units)
    assert [u[1] for u in units if u[0] == "table_row"] == ["1 | lamp | 3", "2 | desk | 4"] and all(len(u[1]) <= 1250 for u in units)
    spans = passages(text)
    assert all(b > c for (_, b), (c, _) in zip(spans[:2], spans[1:3]))
    df = spark.createDataFrame([("d", 1, text), ("e", 1, None), ("f", 1, "")], "document_id string, page int, text string")
    assert chunk_pages(df).count() == len(units)


def test_evaluation():
    g = [V.Golden("q1", "a", "x", relevant={"d1": 3, "d2": 1}), V.Golden("q2", "a", "y", unanswerable=True), V.Golden("q3", "a", "z", value=3.0)]
    answers = {("a", "x"): (["d1", "d9", "d2"], None), ("a", "z"): ([], 3.0)}
    scores, leaked = V.run(g, lambda t, q: answers.get((t, q), ([], None)), ["a", "b"])
    means = V.summary(scores)
    assert leaked == 0 and means["reciprocal_rank"] == 1.0 and means["recall_at_k"] == 1.0 and means["false_positive"] == 0.0 and means["computed"] == 1.0 and 0.9 < means["ndcg"] < 1
    assert V.failed_gates(means, {"reciprocal_rank": 0.9}, {"false_positive": 0.0}) == [] and V.regressions(scores, scores) == []
