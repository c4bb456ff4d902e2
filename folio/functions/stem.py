"""English stems by the published Porter2 algorithm, taken of distinct words and joined back."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOWEL = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Fixed values of the published algorithm: irregular words and the suffix tables of steps 2 and 3.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        m = re.search(rf"[{VOWEL}][^{VOWEL}]", w[start:])
        return start + m.end() if m else len(w)

    first = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if first is None else first
    return r1, after(r1)


def _short_end(w: str) -> bool:
    return bool(re.search(rf"(?:[^{VOWEL}][{VOWEL}][^{VOWEL}wxY]|^[{VOWEL}][^{VOWEL}])$", w))


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    w = word.lower().lstrip("'")
    if len(w) <= 2:
        return w
    if w in SPECIAL:
        return SPECIAL[w]
    w = re.sub(rf"(?<=[{VOWEL}])y", "Y", re.sub("^y", "Y", w))
    r1, r2 = _regions(w)
    w = re.sub("(?:'s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{VOWEL}]", w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    if m := re.search("(?:eedly|eed)$", w):
        w = w[: m.start()] + "ee" if m.start() >= r1 else w
    elif (m := re.search("(?:ingly|edly|ing|ed)$", w)) and re.search(f"[{VOWEL}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWEL:
        w = w[:-1] + "i"
    for end, new in STEP2:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ogi" or w[at - 1 : at] == "l") and (end != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + new
            break
    for end, new in STEP3:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= (r2 if end == "ative" else r1):
                w = w[:at] + new
            break
    for end in STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(StringType())
def stem_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda w: None if w is None else stem(w))


def with_stems(words: DataFrame) -> DataFrame:
    """Postings (term, ...) with the stem of each term; stems are computed once for each different word."""
    stems = words.select("term").distinct().withColumn("stem", stem_udf("term"))
    return words.join(stems, "term")
