import random

import numpy as np
from folio.llm.leaks import ItemIndex, find_leaks
from folio.llm.words import words


def brute(text, items, run=12):
    grams = {tuple(text[i : i + run]) for i in range(len(text) - run + 1)}
    return {i for i, w in items if any(tuple(w[p : p + run]) in grams for p in range(len(w) - run + 1))}


def test_index_equals_brute_force():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(k, [r.choice(vocabulary) for _ in range(r.randint(5, 40))]) for k in range(70)]
    index = ItemIndex(items)
    for _ in range(200):
        text = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            _, w = r.choice(items)
            a = r.randrange(len(w))
            text[r.randint(0, len(text)) : 0] = w[a : a + r.choice((8, 11, 12, 15, 30))]
        assert set(index.leaks(text)) == brute(text, items)


def test_rows(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, f"x {item.upper()}, y", "x"), (1, f"x {item.upper()}, y", "x"), (2, "one two three", "x"), (3, None, "x"), (4, "", "x"), (5, "filler " * 50_000 + item, "x"), (6, " ".join(item.split()[:11]), "x")]
    corpus = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "too short"), (None, item), (10, "")], "item_id long, text string")
    out = {tuple(r) for r in find_leaks(corpus, items).collect()}
    assert out == {(1, 7, 13), (5, 7, 13)}
    assert find_leaks(corpus, items.limit(0)).count() == 0 and find_leaks(corpus.limit(0), items).count() == 0
    assert words("Ein-Wort, zwei_Wörter") == ["ein", "wort", "zwei", "wörter"]


def test_rows_come_from_the_index(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    items = [(r["item_id"], words(r["text"])) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    texts = [words(r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if r["text"]]
    index = ItemIndex(items)
    found = [set(index.leaks(t)) for t in texts]
    assert found == [brute(t, items) for t in texts] and any(found)
    # Few pairs of passage and item are left to verify, and no row comes from elsewhere.
    passages = sum(len(range(0, len(t) - 11, 12)) for t in texts if len(t) >= 12)
    looked = sum(sum(1 for _ in index.candidates(np.array([index.number.get(w, index.other) for w in t]))) for t in texts if len(t) >= 12)
    assert looked < 0.02 * passages * len(items)
    monkeypatch.setattr(ItemIndex, "candidates", lambda self, numbers: iter(()))
    assert not any(index.leaks(t) for t in texts)


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr("folio.llm.leaks.SHARD", 2)
    monkeypatch.setattr("folio.llm.leaks.SHARDS_A_PASS", 2)
    items = [(k, " ".join(f"w{k}x{i}" for i in range(14))) for k in range(7)]
    corpus = spark.createDataFrame([(k, f"and {t} again") for k, t in items], "doc_id long, text string")
    out = {tuple(r) for r in find_leaks(corpus, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert out == {(k, k, 14) for k in range(7)}
