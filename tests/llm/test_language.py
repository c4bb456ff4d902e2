from folio.llm.language import LanguageModel, cases, identify, word_counts

TESTDATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = [(r["language"], r["text"]) for r in spark.read.parquet(f"{TESTDATA}/lang_samples.parquet").orderBy("sample_id").collect()]
    model = LanguageModel(word_counts(rows[::2]))
    labels = [model.languages[int(sum(p[1] for p in paragraphs).argmax())] for paragraphs in model.label([t for _, t in rows[1::2]])]
    right = sum(a == b for a, (b, _) in zip(labels, rows[1::2]))
    assert right >= 0.97 * len(labels)


def test_rows(spark):
    samples = spark.read.parquet(f"{TESTDATA}/lang_samples.parquet")
    english = "The supplier was informed that the contract ends with the month and that all invoices are due."
    german = "Der Vertrag wird mit dem Ende des Monats und nach der letzten Mahnung ohne weitere Angaben beendet."
    docs = [
        (1, english, "en-GB", 0), (2, english, "DE", 0), (3, english, None, 0), (4, f"{english} {english}\n\n{german}", "en", 0), (5, None, "en", 0), (6, "", None, 0), (7, "a1b2c3 " * 40, None, 0),
        (8, (english + " ") * 4000, "en", 0), (2, english, "DE", 0), (None, english, "xx", 0), (9, "中文文件 " * 10, None, 0), (10, "Guten Tag", None, 0), (11, "XheF/RowUB+zXMJQ/GQPIkO+yIDHia/kZjAApB/iNGLmGw+XURLHTz/ABEj+XkiZRH/GezXAA/egGBspnJqKe/POznbRpp", None, 0),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, language string, seg_no int")
    found = identify(df, samples)
    main = {r["doc_id"]: (r["language"], r["confidence"]) for r in found.where("seg_no = 0").collect()}
    assert main[1][0] == main[4][0] == main[8][0] == "en" and main[1][1] > 0.9 and main[5] == main[6] == main[7] == main[9] == main[11] == ("und", 0.0)
    out = {tuple(r) for r in cases(found).collect()}
    assert out == {(2, 0, "en"), (3, 0, "en"), (4, 2, "de"), (None, 0, "en")}
    assert cases(identify(df.limit(0), samples)).count() == 0
    assert {r["language"] for r in identify(df, samples.limit(0)).collect()} == {"und"}


def test_the_state_is_carried_through_long_texts():
    model = LanguageModel(word_counts([("en", "the house of the people is on the hill and it was old"), ("de", "das Haus der Leute ist auf dem Berg und es war alt")]))
    english, german = "the house of the people is on the hill ", "das Haus der Leute ist auf dem Berg "
    # One foreign word never pays for two switches, wherever it stands in the text.
    for at in (511, 512, 513, 2000):
        text = (english * 400).split()
        text[at] = "alt"
        (paragraph,) = model.label([" ".join(text)])[0]
        assert paragraph[1].tolist() == [0, len(text)]
    long, short = english * 40_000, german
    found = model.label([short, long, "", long + "\n\n" + german * 3])
    assert [[p[1].argmax() for p in one] for one in found] == [[0], [1], [], [1, 0]]


def test_repeated_and_null_ids_keep_their_own_main_language(spark):
    samples = spark.read.parquet(f"{TESTDATA}/lang_samples.parquet")
    english = "The supplier was informed that the contract ends with the month and that all invoices are due."
    german = "Der Vertrag wird mit dem Ende des Monats und nach der letzten Mahnung ohne weitere Angaben beendet."
    docs = [(1, f"{english} {english}\n\n{german}", "en"), (1, f"{german} {german}\n\n{english}", "de"), (None, f"{english} {english}\n\n{german}", "en")]
    out = {tuple(r) for r in cases(identify(spark.createDataFrame(docs, "doc_id long, text string, language string"), samples)).collect()}
    assert out == {(1, 2, "de"), (1, 2, "en"), (None, 2, "de")}
