import random

import numpy as np

from folio.llm.neardup import Shingler, grouped, linked_pairs, positional_bytes
from folio.llm.words import words


def brute(rows, similarity=0.6):
    shingles = Shingler(4)
    sets = [(p, i, t, set(shingles(t)[1].tolist()) if t and shingles(t)[0] >= 40 else None) for p, i, t in set(rows)]
    found = set()
    for p, i, t, x in sets:
        for q, j, u, y in sets:
            if x and y and p == q and i is not None and j is not None and i < j and t != u and len(x & y) >= similarity * len(x | y):
                found.add((p, i, j))
    return found


def test_equals_brute_force(spark):
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(60):
        base = [r.choice(vocabulary) for _ in range(r.randint(30, 120))]
        for _ in range(r.randint(1, 5)):
            new = list(base)
            for _ in range(r.randint(0, 6)):
                new[r.randrange(len(new))] = r.choice(vocabulary)
            rows.append((r.choice("ab"), len(rows), " ".join(new) + r.choice(("", ".", "!"))))
    hot = " ".join(vocabulary)
    rows += [("a", 1000 + k, hot) for k in range(50)] + [("a", 2000, hot.upper()), ("a", 2001, hot + " more")]
    rows += [rows[0], ("a", 5000, None), ("a", 5001, ""), ("a", None, hot), ("b", 5002, "one two " * 20_000)]
    df = spark.createDataFrame(rows, "part string, record_id long, text string").selectExpr("*", "1 as class_id", "2 as n")
    found = [tuple(x) for x in linked_pairs(df.repartition(3)).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)
    groups = grouped(df).collect()
    group = {(x["part"], x["record_id"]): x["group_id"] for x in groups}
    assert all(group[p, a] == group[p, b] for p, a, b in found)
    assert linked_pairs(df.limit(0)).count() == 0 and grouped(df.limit(0)).count() == 0


def test_small_sets_share_few(spark):
    rows = [("p", "a", "x " * 40 + "y"), ("p", "b", "x " * 40 + "y z"), ("p", "c", "x " * 40 + "q r s t u"), ("p", "d", "x " * 40), ("p", "e", "w " * 40)]
    found = {(r["id_a"], r["id_b"]) for r in linked_pairs(spark.createDataFrame(rows, "part string, record_id string, text string")).collect()}
    assert found == {("a", "b")}


def test_ids_with_several_texts(spark):
    rows = []
    for k in range(12):
        base = " ".join(f"w{k}n{i}" for i in range(50))
        rows += [("p", f"a{k}", base), ("p", f"b{k}", base + " more")]
        rows += [("p", f"a{k}", " ".join(f"{c}{k}n{i}" for i in range(60))) for c in "uv"]
        rows += [("p", f"c{k}", " ".join(f"u{k}n{i}" for i in range(60)) + " end")]
    found = {(r["id_a"], r["id_b"]) for r in linked_pairs(spark.createDataFrame(rows, "part string, record_id string, text string")).collect()}
    assert found == {pair for k in range(12) for pair in ((f"a{k}", f"b{k}"), (f"a{k}", f"c{k}"))}


def made(r, n=40):
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(n):
        base = [r.choice(vocabulary) for _ in range(r.randint(40, 90))]
        for _ in range(r.randint(1, 4)):
            new = list(base)
            for _ in range(r.randint(0, 5)):
                new[r.randrange(len(new))] = r.choice(vocabulary)
            rows.append((r.choice("ab"), len(rows), " ".join(new)))
    return rows


def test_positional_bytes_are_shared_at_least_as_often_as_shingles():
    r = np.random.default_rng(7)
    for positions in (1, 2, 16, 4096):
        for _ in range(50):
            common = r.integers(0, 2**63, r.integers(1, 60)).astype(np.uint64)
            sets = [np.unique(np.concatenate([common, r.integers(0, 2**63, r.integers(0, 60)).astype(np.uint64)])) for _ in "ab"]
            a, b = (positional_bytes(h, positions) for h in sets)
            assert len(np.unique(a)) == len(sets[0]) and len(np.intersect1d(a, b)) >= len(np.intersect1d(*sets))
            first = a[a < positions * 256]
            assert set((first & 255).tolist()) <= {int(h) & 255 for h in sets[0]} and set((first >> 8).tolist()) == {(int(h) >> 8) % positions for h in sets[0]}


def test_long_lists_are_split_and_small_tables_lose_nothing(spark, monkeypatch):
    rows = made(random.Random(2))
    df = spark.createDataFrame(rows, "part string, record_id long, text string")
    for name, value in (("LONG_LIST", 2), ("SHINGLES_A_POSITION", 1 << 40)):
        monkeypatch.setattr(f"folio.llm.neardup.{name}", value)
        assert {tuple(x) for x in linked_pairs(df).collect()} == brute(rows)


def test_links_come_from_the_positional_bytes(spark, monkeypatch):
    rows = made(random.Random(3))
    assert brute(rows)
    real = positional_bytes
    monkeypatch.setattr("folio.llm.neardup.positional_bytes", lambda h, positions: real(h * (h.sum() | np.uint64(1)), positions))  # bytes that no other record has
    assert linked_pairs(spark.createDataFrame(rows, "part string, record_id long, text string")).count() == 0


def test_shingles_are_those_of_the_words(spark):
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + ["", "one", "a_b c-d É½² " * 3, "x" * 5000 + " y z w", "1 2 3 4", "\n\n", "İstanbul ΣΑΣ ss"]
    counts, hashes = Shingler(4).several(texts)
    names = {}
    for text, n, h in zip(texts, counts, hashes):
        w = words(text)
        assert n == len(w) and len(h) == max(0, len(w) - 3)
        for i, x in enumerate(h.tolist()):
            assert names.setdefault(x, tuple(w[i : i + 4])) == tuple(w[i : i + 4])
    assert len(set(names.values())) == len(names)
    assert all(np.array_equal(np.unique(h), Shingler(4)(t)[1]) for t, h in zip(texts, hashes))
