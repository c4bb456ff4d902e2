import random

from folio.llm.names import channel, edits, keys, link_spellings, parse, spelling_pairs


def test_parse():
    assert parse("Dr. Andrew Marlowe") == parse("MARLOWE Andrew") == parse("Marlowe, Andrew") == ("p", "marlowe", "andrew", "")
    assert parse("Marlowe, A.S.") == ("p", "marlowe", "a", "s") and parse("A. Marlowe") == parse("Marlowe A.") == ("p", "marlowe", "a", "")
    assert parse("The Lumen Harrow Svcs Corp.") == parse("LUMEN HARROW SERVICES CORPORATION") == ("o", "lumen harrow", "services", "corp")
    assert parse("LumenHarrow Foods A.G.")[1:] == ("lumen harrow", "foods", "ag") and parse("Lumen Harrow Foods GesmbH")[3] == "gmbh"


def test_channel_and_keys():
    assert edits("ca", "abc") == 3 and edits("hartwlel", "hartwell") == 1 and edits("abc", "abc") == 0
    for variant, canonical in (("Andy Marlowe", "Andrew Marlowe"), ("Andrew Marolwe", "Andrew Marlowe"), ("Lumen Harow Services", "Lumen Harrow Services Corp"), ("Services Harrow Lumen", "Lumen Harrow Services Corp")):
        v, c = parse(variant), parse(canonical)
        assert channel(v, c) < 20 and keys(v, False) & keys(c, True)
    assert channel(parse("Susan Marlowe"), parse("Andrew Marlowe")) == float("inf")
    assert channel(parse("Lumen Harrow Foods Ltd"), parse("Lumen Harrow Services Ltd")) == float("inf")


def test_rows(spark):
    names = ["Andrew Marlowe"] * 5 + ["Andy Marlowe", "A. Marlowe", "MARLOWE Andrew", "Andrew Marlwoe", "Susan Marlowe", "Lumen Harrow Foods Ltd", "The Lumen Harrow Foods Limited", None, "", "  ", "x" * 20_000, "??"]
    df = spark.createDataFrame([(n, 1) for n in names], "name string, form int")
    linked = link_spellings(df)
    rows = linked.collect()
    assert len(rows) == len({n for n in names if n and n.strip()})
    pairs = {tuple(r) for r in spelling_pairs(linked).collect()}
    assert ("A. Marlowe", "Andrew Marlowe") in pairs and ("Andrew Marlowe", "Andy Marlowe") in pairs and ("Andrew Marlowe", "Andrew Marlwoe") in pairs
    assert ("Lumen Harrow Foods Ltd", "The Lumen Harrow Foods Limited") in pairs and not any("Susan Marlowe" in p for p in pairs)
    assert all(a < b for a, b in pairs) and len(pairs) == 11
    assert link_spellings(df.limit(0)).count() == 0


def slow_distance(a, b):
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def mistyped(r, text):
    i, kind = r.randrange(len(text)), r.randrange(4)
    x = r.choice("abcdez")
    return (text[:i] + text[i + 1 :], text[:i] + x + text[i:], text[:i] + x + text[i + 1 :], text[:i] + text[i + 1 : i + 2] + text[i] + text[i + 2 :])[kind]


def test_distance_equals_the_plain_one():
    r = random.Random(6)
    for _ in range(3000):
        a = "".join(r.choice("abc") for _ in range(r.randint(1, 30)))
        b = a
        for _ in range(r.randint(0, 4)):
            b = mistyped(r, b) or "a"
        assert edits(a, b) == min(3, slow_distance(a, b))
    assert edits("continental freight and storage", "cnotinental freight and stoarge") == 2


def test_no_link_of_the_channel_is_without_a_key():
    r = random.Random(8)
    given = ["anna", "andrew", "andy", "drew", "bill", "william", "will", "robert", "bob", "jo", "al", "a", "w", "b", "", "lena", "leonard", "christopher"]
    forms = []
    for _ in range(250):
        surname = "".join(r.choice("abcdek") for _ in range(r.choice((3, 4, 4, 5, 8, 9, 10, 11, 13, 40))))
        for _ in range(4):
            v, g = surname, r.choice(given)
            for _ in range(r.randint(0, 2)):
                v = mistyped(r, v) or "b"
            g = mistyped(r, g) if len(g) > 3 and r.random() < 0.4 else g
            forms.append(("p", v, g, r.choice(("", "m"))))
        core = " ".join("".join(r.choice("abcdek") for _ in range(r.choice((2, 4, 6, 9, 30)))) for _ in range(r.choice((1, 2, 2, 3))))
        for _ in range(4):
            v = core
            for _ in range(r.randint(0, 2)):
                v = " ".join(mistyped(r, v).split()) or "b"
            w = v.split()
            forms.append(("o", " ".join(r.choice((w, w[1:] + w[:1], sorted(w)))), r.choice(("", "services")), r.choice(("", "inc"))))
    some = {f: (keys(f, False), keys(f, True)) for f in set(forms)}
    linked = 0
    for v in some:
        for c in some:
            if v != c and channel(v, c) < float("inf"):
                linked += 1
                assert some[v][0] & some[c][1], (v, c)
    assert linked > 2000


def test_errors_in_short_and_long_names(spark):
    names = ["John Kent"] * 3 + ["John Kemt"] + ["Anna Lane"] * 3 + ["Anna Lnae"] + ["Continental Freight Services Inc"] * 3 + ["Contniental Frieght Services Inc"] + ["Anna Maria Smith"] * 3 + ["Anna M. Smith", "SMITH, Anna Maria"]
    pairs = {tuple(x) for x in spelling_pairs(link_spellings(spark.createDataFrame([(n,) for n in names], "name string"))).collect()}
    assert pairs == {
        ("John Kemt", "John Kent"), ("Anna Lane", "Anna Lnae"), ("Continental Freight Services Inc", "Contniental Frieght Services Inc"),
        ("Anna M. Smith", "Anna Maria Smith"), ("Anna M. Smith", "SMITH, Anna Maria"), ("Anna Maria Smith", "SMITH, Anna Maria"),
    }
