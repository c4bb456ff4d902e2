"""Problem 4: spellings of the same person or organisation.

Noisy-channel attribution. Every spelling is parsed (titles, legal forms, word order, initials).
A frequent, complete spelling is a candidate canonical form; a variant is attached to the
candidate with the greatest posterior: the logarithm of its frequency (prior) plus that of the
likelihood of writing the variant for it (typing errors, abbreviations, nicknames, initials).
Candidates are found by keys that a spelling shares with every form the channel may have made it
from, so no link is lost and no two unrelated names are ever paired.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.durable import materialize, with_rank

# Titles, legal forms (each line one form), words of business with abbreviations, nicknames.
TITLES = frozenset("dr mr mrs ms miss prof sir herr frau mme dipl ing".split())
LEGAL = {
    form: line.split()[0]
    for line in (
        "inc incorporated", "corp corporation", "co company", "ltd limited", "llc", "llp", "plc", "ag aktiengesellschaft", "gmbh gesmbh gesellschaftmbh mbh gesellschaft",
        "kg", "ohg", "kgaa", "se", "sa", "sas", "sarl", "srl", "spa", "bv", "nv", "oy", "ab", "as", "aps", "pty",
    )
    for form in line.split()
}
BUSINESS = {
    form: line.split()[0]
    for line in (
        "associates assoc assocs", "brothers bros", "construction constr const", "consulting", "development dev", "distribution distr dist", "engineering eng engg engrg",
        "enterprises ent", "foods", "group grp", "holding holdings hldg hldgs", "industries ind inds", "international intl", "laboratories labs lab laboratory", "logistics log",
        "management mgmt", "manufacturing mfg manuf", "partners ptnrs", "products prods", "services svcs svc service serv", "solutions", "systems sys", "technologies tech technology techn",
        "trading", "transport transp",
    )
    for form in line.split()
}
NICKNAMES = {
    nick: set(names.split())
    for nick, names in (
        line.split(": ")
        for line in (
            "al: alexander albert alan alfred", "alec: alexander", "alex: alexander alexandra", "sandy: alexander alexandra", "xander: alexander", "andy: andrew", "drew: andrew", "ben: benedict benjamin", "benny: benedict benjamin",
            "bernie: bernard", "beth: elizabeth", "betsy: elizabeth", "betty: elizabeth", "eliza: elizabeth", "libby: elizabeth", "lisa: elizabeth", "liz: elizabeth", "lizzie: elizabeth", "lizzy: elizabeth", "bill: william", "billy: william",
            "liam: william", "will: william", "willie: william", "willy: william", "bob: robert", "bobby: robert", "rob: robert", "cate: catherine katherine", "cathy: catherine katherine", "charlie: charlotte charles", "chuck: charles",
            "lottie: charlotte", "lotte: charlotte", "chris: christopher christine", "kit: christopher katherine", "topher: christopher", "dan: daniel", "danny: daniel", "dave: david", "deb: deborah", "debbie: deborah", "debby: deborah",
            "debra: deborah", "dick: richard", "rich: richard", "richie: richard", "rick: richard", "ricky: richard", "don: donald", "ed: edward edmund", "eddie: edward", "ted: theodore edward", "teddy: theodore edward", "theo: theodore",
            "dora: theodora", "fran: frances francis", "francie: frances", "frankie: frances francis", "frank: francis", "fanny: frances", "fred: frederick alfred", "freddie: frederick", "freddy: frederick", "fritz: frederick",
            "geoff: geoffrey", "greg: gregory", "hank: henry", "harry: henry harold", "jack: john", "jim: james", "jimmy: james", "jo: josephine joanna", "josie: josephine", "joe: joseph", "achim: joachim", "jochen: joachim", "joch: joachim",
            "kate: katherine", "kathie: katherine", "kathy: katherine", "katie: katherine", "katy: katherine", "kay: katherine", "kitty: katherine", "ken: kenneth", "kenny: kenneth", "len: leonard", "lennie: leonard", "lenny: leonard",
            "leo: leonard", "larry: lawrence", "maggie: margaret", "madge: margaret", "marge: margaret", "margie: margaret", "meg: margaret", "peg: margaret", "peggy: margaret", "greta: margaret", "matt: matthew", "mick: michael",
            "mike: michael", "nick: nicholas", "pat: patrick patricia", "paddy: patrick", "rick: richard", "ron: ronald", "sam: samuel samantha", "sammy: samuel", "steve: stephen steven", "sue: susanna susan", "susan: susanna",
            "susie: susanna susan", "suzie: susanna susan", "suzy: susanna susan", "sanna: susanna", "thom: thomas", "tom: thomas", "tommy: thomas", "tony: anthony", "tori: victoria", "vic: victoria victor", "vicki: victoria", "vicky: victoria",
            "vickie: victoria", "vin: vincent", "vince: vincent", "vinnie: vincent", "vinny: vincent",
        )
    )
}

#: Letters of a surname and of an organisation's words from which on two typing errors are allowed, not one.
TWO_ERRORS, TWO_ERRORS_WORDS = 10, 12
#: Letters of a half of a name that are used for keys; of a longer half only this many at the name's end.
LONG_KEY = 24

_GLUED = re.compile(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ][a-zß-ÿ])")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
#: Costs (negative log likelihoods) of the channel.
TYPO, NICKNAME, INITIAL, DROPPED, OTHER_LEGAL, OTHER_MIDDLE = 4.0, 2.0, 2.5, 1.0, 1.5, 3.0


def parse(name: str) -> tuple[str, ...]:
    """('p', surname, given, middle) of a person or ('o', words joined by blanks, business, legal)."""
    text = unicodedata.normalize("NFKC", name)
    initials = bool(re.fullmatch(r"\s*[^\W\d_]+(?:[-'’][^\W\d_]+)*,\s*(?:[^\W\d_]\.\s*)+", text))  # a surname and initials, not a legal form
    text = re.sub(r"\b(?:[A-Za-z]\.){2,}(?=\W|$)", lambda m: " ".join(m.group().replace(".", "")) if initials else _dotted(m.group()), text)
    split = " ".join(_GLUED.sub(" ", part) if not re.fullmatch(r"\W*(?:G|Ges)mbH\W*", part) else part for part in text.split())
    comma = split.find(",")
    tokens = [(m.group(), m.start()) for m in _TOKEN.finditer(split)]
    tokens = [(t, at) for t, at in tokens if t.lower() not in TITLES or len(tokens) == 1]
    lower = [t.lower() for t, _ in tokens]
    legal = [w for w in lower if w in LEGAL]
    business = [BUSINESS[w] for w in lower if w in BUSINESS]
    if legal or business or not tokens:
        core = [w for w in lower if w not in LEGAL and w not in BUSINESS and w != "the"]
        kinds = {LEGAL[w] for w in legal}
        return ("o", " ".join(core) or " ".join(lower), " ".join(sorted(set(business))), " ".join(sorted(kinds)))
    whole = [(w, at) for (w, at) in zip(lower, (at for _, at in tokens)) if len(w) > 1]
    short = [w for w in lower if len(w) == 1]
    if len(whole) < 1 or len(whole) > 3:
        return ("o", " ".join(lower), "", "")
    if len(whole) == 3:  # a second given name counts as its initial
        (a, at_a), (b, at_b), (c, at_c) = whole
        written = {at: t for t, at in tokens}
        if at_a < comma < at_b or (written[at_a].isupper() and not written[at_c].isupper()):
            return ("p", a, b, c[0])
        return ("p", c, a, b[0])
    if len(whole) == 1:
        return ("p", whole[0][0], short[0] if short else "", short[1] if len(short) > 1 else "")
    (a, at_a), (b, at_b) = whole
    written = {at: t for t, at in tokens}
    first_is_surname = at_a < comma < at_b or (written[at_a].isupper() and not written[at_b].isupper())
    surname, given = (a, b) if first_is_surname else (b, a)
    return ("p", surname, given, short[0] if short else "")


def _dotted(text: str) -> str:
    letters = text.replace(".", "")
    return letters if letters.lower() in LEGAL else " ".join(letters)


def _hash(key: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"))


def _shorter(text: str) -> set[str]:
    """The text without one of its letters."""
    return {text[:i] + text[i + 1 :] for i in range(len(text))}


def _halves(length: int) -> tuple[int, int]:
    return min(length // 2, LONG_KEY), min(length - length // 2, LONG_KEY)


def _variant_keys(text: str, two: int) -> set[str]:
    """Keys of a text of which it shares one with every text of which it is a variant by one typing error, or by
    two where that has ``two`` letters or more.

    Of one error both texts are equal without a letter. Of two errors one half of the other text holds
    one at most, so that half and the letters at this text's end are equal without a letter; which
    letters they are depends on the other's length.
    """
    n, found = len(text), set()
    if n - 1 < two:
        found.update((f"={text}", *(f"={x}" for x in _shorter(text))))
    for length in range(max(two, n - 2), n + 3):
        head, tail = _halves(length)
        for size in (head, head + 1):
            found.update(f"<{head}:{x}" for x in _shorter(text[:size]) | ({text} if n < size else set()))
        for size in (tail, tail + 1):
            found.update(f">{tail}:{x}" for x in _shorter(text[-size:]) | ({text} if n < size else set()))
    return found


def _canonical_keys(text: str, two: int) -> set[str]:
    """The other side of _variant_keys."""
    if len(text) < two:
        return {f"={text}", *(f"={x}" for x in _shorter(text))}
    head, tail = _halves(len(text))
    low, high = text[:head], text[-tail:]
    return {f"<{head}:{x}" for x in (low, *_shorter(low))} | {f">{tail}:{x}" for x in (high, *_shorter(high))}


def _ends(given: str) -> set[str]:
    """Of two given names that differ by one error one of these is equal."""
    return {f"f{given[:2]}", f"l{given[-2:]}", *((f"e{given[0]}{given[-1]}",) if len(given) == 4 else ())}


def _given_keys(given: str, canonical: bool) -> set[str]:
    """Keys of a given name for _given(): a variant shares one with every canonical name it may stand for."""
    other = NICKNAMES.get(given, ())
    if not canonical:
        if len(given) < 2:
            return {f"i{given}" if given else "*"}
        return _ends(given) | {f"f{name[:2]}" for name in other}
    found = {"*"}
    if given:
        found.update((f"i{given[0]}", *(f"i{name[0]}" for name in other)))
    if len(given) > 1:
        found |= _ends(given) | {f"f{name[:2]}" for name in other}
    return found


def keys(parsed: tuple[str, ...], canonical: bool) -> set[str]:
    """Keys of a name as a variant or as a canonical form. Wherever channel(variant, form) is finite, the two share one."""
    if parsed[0] == "p":
        names = _canonical_keys(parsed[1], TWO_ERRORS) if canonical else _variant_keys(parsed[1], TWO_ERRORS)
        given = _given_keys(parsed[2], canonical)
        return {f"p{g}:{k}" for k in names for g in given}
    words = parsed[1].split()
    if not canonical:
        return {f"o{k}" for k in _variant_keys("".join(words), TWO_ERRORS_WORDS)}
    orders = {"".join(words), "".join(words[1:] + words[:1]), "".join(sorted(words))}
    return {f"o{k}" for text in orders for k in _canonical_keys(text, TWO_ERRORS_WORDS)}


def edits(a: str, b: str, most: int = 2) -> int:
    """Optimal string alignment distance, or most + 1 when it is greater."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    a, b, high = a[low:], b[low:], 0
    while high < min(len(a), len(b)) and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[: len(a) - high], b[: len(b) - high]
    far = most + 1
    before: dict[int, int] = {}
    row = {j: j for j in range(min(len(b), most) + 1)}  # only places near the diagonal can be reached
    for i, x in enumerate(a, 1):
        new = {0: i} if i <= most else {}
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            d = min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before.get(j - 2, far) + 1)
            new[j] = d
        before, row = row, new
        if min(row.values(), default=far) > most:
            return far
    return min(row.get(len(b), far), far)


def channel(variant: tuple[str, ...], canonical: tuple[str, ...]) -> float:
    """Cost of writing the variant for the canonical form; infinite where it is no spelling of it."""
    if variant[0] != canonical[0]:
        return math.inf
    if variant[0] == "o":
        v, c = variant[1].split(), canonical[1].split()
        far = min(edits("".join(v), "".join(x)) for x in (c, c[1:] + c[:1], sorted(c)))
        if far > (2 if len("".join(c)) >= TWO_ERRORS_WORDS else 1):
            return math.inf
        cost = TYPO * far
        if variant[2] != canonical[2]:
            if variant[2] and canonical[2]:
                return math.inf
            cost += DROPPED
        if variant[3] != canonical[3]:
            cost += OTHER_LEGAL if variant[3] and canonical[3] else DROPPED
        return cost
    far = edits(variant[1], canonical[1])
    if far > (2 if len(canonical[1]) >= TWO_ERRORS else 1):
        return math.inf
    given = _given(variant[2], canonical[2])
    cost = TYPO * far + given
    if variant[3] and canonical[3] and variant[3] != canonical[3]:
        cost += OTHER_MIDDLE
    return cost


def _given(v: str, c: str) -> float:
    if v == c:
        return 0.0
    if not v:
        return 2 * INITIAL
    if not c or (len(c) == 1 and len(v) > 1):
        return math.inf
    if len(v) == 1:
        return INITIAL if c[0] == v or any(name[0] == v for name in NICKNAMES.get(c, ())) else math.inf
    if c in NICKNAMES.get(v, ()) or (len(v) >= 3 and c.startswith(v)):
        return NICKNAME
    if NICKNAMES.get(v, set()) & NICKNAMES.get(c, set()):
        return 2 * NICKNAME
    far = edits(v, c, 1)
    return TYPO if far == 1 and min(len(v), len(c)) >= 4 else math.inf


def rank(parsed: tuple[str, ...]) -> int:
    """Completeness: a form may stand for less complete ones only."""
    if parsed[0] == "o":
        return 4 + bool(parsed[2]) * 2 + bool(parsed[3])
    if len(parsed[2]) < 2:
        return len(parsed[2])
    return 3 if parsed[2] in NICKNAMES else 4


def link_spellings(names: DataFrame) -> DataFrame:
    """(name, canonical, cost): for every distinct name its canonical form, from a table (name) with a
    row for each use of a name.

    Names that are null, empty or blank have no row. canonical is the parsed form of the most
    probable spelling, cost the channel's cost of the first step to it. Ties are decided by
    frequency, then by the form itself. Names are counted before anything is joined, so a name
    that is used often weighs no more than a rare one later. Other columns are not read.
    """
    named = names.select(F.col("name").cast("string").alias("name")).where(F.length(F.trim("name")) > 0)
    counted = named.groupBy("name").agg(F.count("*").alias("weight"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [parse(n) for n in batch.column(0).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(["|".join(f) for f in forms], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([rank(f) for f in forms], pa.int32())], ["name", "weight", "form", "rank"])

    spelled = materialize(counted.mapInArrow(parsed, "name string, weight long, form string, rank int"))
    forms = spelled.groupBy("form").agg(F.sum("weight").alias("weight"), F.first("rank").alias("rank"))
    # A form may only stand for those before it in this order.
    forms = materialize(with_rank(forms, "place", "rank", "weight", "form"))

    def keyed(canonical: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    places, found = [], []
                    for place, form in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        some = keys(tuple(form.split("|")), canonical)
                        found += map(_hash, some)
                        places += [place] * len(some)
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.uint64()).view(pa.int64()), pa.array(places, pa.int64())], ["key", "place"])

        # Forms are few bytes but many keys: they are spread before keys are made, and the keys are never broadcast.
        spread = forms.select("place", "form").repartition(int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions")), "place")
        return spread.mapInArrow(run, "key long, place long")

    a, b = keyed(False).withColumnRenamed("place", "place_v"), keyed(True).withColumnRenamed("place", "place_c")
    met = materialize(a.join(b.hint("merge"), "key").where("place_v < place_c").select("place_v", "place_c").distinct())
    pairs = met.join(forms.select(F.col("place").alias("place_v"), F.col("form").alias("v")), "place_v").join(
        forms.select(F.col("place").alias("place_c"), F.col("form").alias("c"), F.col("weight").alias("w")), "place_c"
    ).select("v", "c", "w")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for v, c, w in zip(*(x.to_pylist() for x in batch.columns)):
                cost = channel(tuple(v.split("|")), tuple(c.split("|")))
                if cost < math.inf:
                    for column, value in zip(out, (v, c, cost, math.log(w) - cost)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.string(), pa.string(), pa.float64(), pa.float64()))], ["v", "c", "cost", "posterior"])

    weighed = pairs.mapInArrow(weigh, "v string, c string, cost double, posterior double")
    best = Window.partitionBy("v").orderBy(F.desc("posterior"), "c")
    chosen = weighed.withColumn("_n", F.row_number().over(best)).where("_n = 1").select(F.col("v").alias("form"), F.col("c").alias("canonical"), "cost")
    chosen = materialize(chosen)
    # A canonical form may itself be a variant of another one: follow to the last, doubling the steps.
    link = chosen.select("form", "canonical")
    while True:
        further = link.select(F.col("form").alias("canonical"), F.col("canonical").alias("next"))
        longer = materialize(link.join(further, "canonical", "left").select("form", F.coalesce("next", "canonical").alias("canonical"), F.col("next").isNotNull().alias("moved")))
        link = longer.select("form", "canonical")
        if not longer.where("moved").limit(1).count():
            break
    found = spelled.select("name", "form").join(link, "form", "left").join(chosen.select("form", "cost"), "form", "left")
    return found.select("name", F.coalesce("canonical", "form").alias("canonical"), F.coalesce("cost", F.lit(0.0)).alias("cost"))


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b): all pairs of different names with one canonical form, name_a < name_b by code points."""
    a, b = linked.select("canonical", F.col("name").alias("name_a")), linked.select("canonical", F.col("name").alias("name_b"))
    return a.join(b, "canonical").where("name_a < name_b").select("name_a", "name_b")
