import random

from folio.llm.encode import TreeEncoder, encode_corpus, ranks_of


def test_tree_equals_whole_and_decodes():
    whole, tree = TreeEncoder(ranks_of()), TreeEncoder(ranks_of(), leaf=7, window=2)
    r = random.Random(5)
    signs = "ab 's\n\n  \té漢👍1２'ll ., 　x\x1c\x85<|endoftext|>"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 300))) for _ in range(400)]
    texts += ["a" * 3000, " " * 3000, "\n" * 999 + "x", "x " * 2000, "", "<|endoftext|> " * 50]
    for t in texts:
        assert tree.encode(t) == whole.encoding.encode_ordinary(t)
        assert tree.decode(tree.encode(t)) == t


def test_rows(spark):
    long = "word " * 40_000
    rows = [(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (None, "a b", "x"), (1, "a b", "x"), (4, long, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = [(r["doc_id"], r["ids"]) for r in encode_corpus(df).collect()]
    assert len(out) == 6 and {i: ids for i, ids in out}[2] == {i: ids for i, ids in out}[3] == []
    direct = TreeEncoder(ranks_of(), leaf=10**9)
    assert dict(out)[4] == direct.encode(long) and dict(out)[1] == dict(out)[None] == direct.encode("a b")
    assert encode_corpus(df.limit(0)).count() == 0


def test_real_documents_are_joined_from_leaves(spark, monkeypatch):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r["text"]]
    tree = TreeEncoder(ranks_of())
    trees = 0
    for t in texts:
        before = tree.joins
        assert tree.encode(t) == tree.encoding.encode_ordinary(t)
        assert tree.joins - before == (len(t) - 1) // tree.leaf
        trees += tree.joins > before
    assert trees > 0.8 * len(texts)
    # Without the joins the ids are others: the rows do come from the tree.
    monkeypatch.setattr(TreeEncoder, "_join", lambda self, text, left, right: (left[0], right[1], left[2] + right[2]))
    assert sum(tree.encode(t) != tree.encoding.encode_ordinary(t) for t in texts) > 0.5 * len(texts)
