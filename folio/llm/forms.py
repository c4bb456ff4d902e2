"""Problem 8: one consistent form for text that looks the same but differs in its characters.

Tokens with irregular characters are read by a weighted edit automaton along a trie of the
corpus' own regular words, where look-alike letters, full-width forms, joined letters, separate
accents and invisible characters cost nothing. The word found most is the canonical spelling, and
the rules on the accepted path tell which forms the token held; a token that matches no word is
brought to its form by table.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.durable import materialize
from folio.llm.automaton import Rules, Trie, count_in_parts, match_in_shards, shard_of
from folio.llm.words import rows

FORMS = ("width", "combining", "invisible", "space", "lookalike")
#: Marks of the automaton's rules.
WIDTH, COMBINING, HIDDEN, LOOKALIKE = 1, 2, 4, 8
_NAMES = {WIDTH: "width", COMBINING: "combining", HIDDEN: "invisible", LOOKALIKE: "lookalike"}
#: Occurrences that make a word a canonical spelling: one that stands once only may itself be a slip. Rarer
#: words are not read by the automaton; tokens that look like them go to the table.
KNOWN = 2
#: Words of the vocabulary in a shard.
SHARD = 50_000

# Character classes and pairs of letters that look alike.
INVISIBLE = (
    r"\u00AD\u034F\u061C\u115F\u1160\u17B4\u17B5\u180B-\u180F\u200B-\u200F\u202A-\u202E\u2060-\u206F\u3164\uFE00-\uFE0F\uFEFF\uFFA0"
)
SPACES = r"\u000B\u000C\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WIDE = r"\uFF10-\uFF19\uFF21-\uFF3A\uFF41-\uFF5A\uFB00-\uFB06\uFB13-\uFB17"
CYRILLIC_LATIN = "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl ѵv ёë їï АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ЁË ЇÏ"
GREEK_LATIN = "αa οo νv ρp ιi κk υu τt χx γy ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX όó άá ίí"
CYRILLIC_GREEK = "оο рρ кκ хχ уγ аα АΑ ВΒ ЕΕ КΚ МΜ НΗ ОΟ РΡ ТΤ ХΧ ПΠ ГΓ ФΦ"

#: What none of the forms can do without: one look tells most texts apart.
_HINT = regex.compile(rf"[\p{{M}}\p{{Greek}}\p{{Cyrillic}}{INVISIBLE}{SPACES}{WIDE}]")
_TOKEN = regex.compile(rf"[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}{INVISIBLE}]*")
_WORD = re.compile(r"[^\W\d_]+")
_GAP = f"[\\p{{M}}{INVISIBLE}]*"
_IRREGULAR = regex.compile(
    rf"[{INVISIBLE}{WIDE}]|\p{{L}}\p{{M}}|\p{{Latin}}{_GAP}[\p{{Greek}}\p{{Cyrillic}}]|[\p{{Greek}}\p{{Cyrillic}}]{_GAP}\p{{Latin}}|\p{{Greek}}{_GAP}\p{{Cyrillic}}|\p{{Cyrillic}}{_GAP}\p{{Greek}}"
)
_SKIP = regex.compile(f"[{INVISIBLE}]")
_SPACE = regex.compile(f"[{SPACES}]")
_WIDTH = regex.compile(f"[{WIDE}]")
_SCRIPTS = {"Latin": regex.compile(r"\p{Latin}"), "Greek": regex.compile(r"\p{Greek}"), "Cyrillic": regex.compile(r"\p{Cyrillic}")}


@lru_cache(maxsize=1)
def _alike() -> dict[str, str]:
    """Character -> the characters that look like it."""
    found: dict[str, str] = {}
    for table in (CYRILLIC_LATIN, GREEK_LATIN, CYRILLIC_GREEK):
        for a, b in table.split():
            found[a] = found.get(a, "") + b
            found[b] = found.get(b, "") + a
    return found


@lru_cache(maxsize=1)
def _classes() -> dict[str, str]:
    """Lower-case character -> the least member of its class of look-alikes, accents left out."""
    parent: dict[str, str] = {}

    def top(c: str) -> str:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    for a, others in _alike().items():
        for b in others:
            x, y = top(unicodedata.normalize("NFD", a.lower())[0]), top(unicodedata.normalize("NFD", b.lower())[0])
            if x != y:
                parent[max(x, y)] = min(x, y)
    return {c: top(c) for c in parent}


def skeleton(token: str) -> str:
    """A key that is equal for all tokens which look the same (and for some more)."""
    plain = unicodedata.normalize("NFKD", _SKIP.sub("", token)).lower()
    classes = _classes()
    return "".join(classes.get(c, c) for c in plain if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def _rules() -> Rules:
    single: dict[str, dict[str, tuple[int, int]]] = {}
    multi: list[tuple[str, str, int, int]] = []
    letters = {c for c in map(chr, range(0x41, 0x530)) if c.isalpha()} | set(_alike())
    accented: dict[str, dict[str, int]] = {}  # a letter and a separate accent -> what they may be, with marks
    for c in letters:
        single[c] = {x.lower(): (0, LOOKALIKE) for x in _alike().get(c, "")} | {c.lower(): (0, 0)}
        parts = unicodedata.normalize("NFD", c)
        if len(parts) == 2 and len(c.lower()) == 1:
            for base in parts[0] + _alike().get(parts[0], ""):
                marks = COMBINING if base == parts[0] else COMBINING | LOOKALIKE
                held = accented.setdefault(base + parts[1], {})
                held[c.lower()] = min(marks, held.get(c.lower(), marks))
    for written, held in accented.items():
        multi += [(written, meant, 0, marks) for meant, marks in held.items()]
    for code in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *range(0xFB00, 0xFB07)):
        plain = unicodedata.normalize("NFKC", chr(code))
        if len(plain) == 1:
            single[chr(code)] = {plain.lower(): (0, WIDTH)}
            for written, held in accented.items():
                if written[0] == plain:
                    multi += [(chr(code) + written[1:], meant, 0, marks | WIDTH) for meant, marks in held.items()]
        else:
            multi.append((chr(code), plain.lower(), 0, WIDTH))
    return Rules(single, multi, {c: HIDDEN for c in map(chr, range(0x10000)) if _SKIP.match(c)})


def _read(words) -> Callable[[str, float], list[tuple]]:
    """The automaton over a shard's words: a token's spelling is the word that keeps most of its own letters,
    then the most frequent one; the marks are those of the accepted path."""
    trie, rules = Trie(zip(words["word"], words["weight"])), _rules()

    def read(token: str, _: float) -> list[tuple[str, str, int]]:
        found = trie.match(token, rules, 0)
        if not found:
            return []
        own = Counter(unicodedata.normalize("NFC", unicodedata.normalize("NFKC", _SKIP.sub("", token))).lower())
        word, _, _, marks = min(found, key=lambda x: (-sum((own & Counter(x[0])).values()), -x[1], x[0]))
        return [(token, word, marks)]

    return read


def _cased(word: str, like: str) -> str:
    like = unicodedata.normalize("NFKC", _SKIP.sub("", like))
    if len(like) > 1 and like.isupper():
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


def _by_table(token: str, main: str) -> tuple[str, int]:
    """The form of a token that matches no known word, and the marks of what it held."""
    bare = _SKIP.sub("", token)
    narrow = _WIDTH.sub(lambda m: unicodedata.normalize("NFKC", m.group()), bare)
    marks = (HIDDEN if bare != token else 0) | (WIDTH if narrow != bare else 0)
    plain = unicodedata.normalize("NFC", narrow)
    held = {name: len(script.findall(narrow)) for name, script in _SCRIPTS.items()}
    mixed = sum(n > 0 for n in held.values()) > 1
    if _accents(narrow, mixed):
        marks |= COMBINING
    if not mixed:
        return plain, marks
    alike = _alike()
    sure = {name: sum(1 for c in script.findall(plain) if c not in alike) for name, script in _SCRIPTS.items()}
    goal = max(_SCRIPTS, key=lambda name: (sure[name], held[name] > 0 and name == main, held[name]))
    wanted = _SCRIPTS[goal]
    out = [c if not c.isalpha() or wanted.match(c) else next((x for x in alike.get(c, "") if wanted.match(x)), c) for c in plain]
    return unicodedata.normalize("NFC", "".join(out)), marks | LOOKALIKE


def normalize(text: str, known: dict[str, tuple[str, int]]) -> tuple[str, list[str]]:
    """The text in its consistent form, and the forms that it held. known: token -> spelling and marks of
    the automaton's path; other irregular tokens go by table."""
    forms: set[str] = set()
    main = max(_SCRIPTS, key=lambda name: len(_SCRIPTS[name].findall(text)))
    out, at = [], 0

    def plain(part: str) -> str:
        if _SKIP.search(part):
            forms.add("invisible")
            part = _SKIP.sub("", part)
        if _SPACE.search(part):
            forms.add("space")
            part = _SPACE.sub(" ", part)
        return part

    for m in _TOKEN.finditer(text):
        token = m.group()
        if not _IRREGULAR.search(token):
            continue
        out.append(plain(text[at : m.start()]))
        at = m.end()
        if token in known:
            word, marks = known[token]
            fixed = _cased(word, token)
        else:
            fixed, marks = _by_table(token, main)
        forms.update(name for mark, name in _NAMES.items() if marks & mark)
        out.append(fixed)
    out.append(plain(text[at:]))
    return "".join(out), sorted(forms)


def _accents(token: str, mixed: bool) -> bool:
    """Whether a letter and a separate accent stand for one accented letter; in a word of mixed
    scripts the letter may itself be a look-alike."""
    alike = _alike() if mixed else {}
    for a, b in zip(token, token[1:]):
        if unicodedata.combining(b) and a.isalpha() and any(len(unicodedata.normalize("NFC", x + b)) == 1 for x in a + alike.get(a, "")):
            return True
    return False


def suspect(text: str | None) -> bool:
    """Whether the text may hold one of the forms."""
    return bool(text and _HINT.search(text) and (_IRREGULAR.search(text) or _SPACE.search(text)))


def irregular_tokens(text: str) -> list[str]:
    return [t for t in _TOKEN.findall(text) if _IRREGULAR.search(t)]


def _words_and_tokens(text: str) -> list[tuple[bool, str] | str]:
    """Regular words in lower case as they are, irregular tokens in a pair."""
    if not suspect(text):
        return _WORD.findall(text.lower())
    tokens = _TOKEN.findall(text)
    odd = [(True, t) for t in tokens if _IRREGULAR.search(t)]
    return [w for t in tokens if not _IRREGULAR.search(t) for w in _WORD.findall(t.lower())] + odd


def _counted(source: DataFrame) -> DataFrame:
    """key, irregular, token, weight: all words and irregular tokens with their counts. The key is equal for all
    tokens that look the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (t for b in batches for t in b.column(0).to_pylist() if t)
        for counts in count_in_parts(map(_words_and_tokens, texts)):
            keys = [k if isinstance(k, tuple) else (False, k) for k in counts]
            columns = ([shard_of(skeleton(k), 1 << 32) for _, k in keys], [odd for odd, _ in keys], [k for _, k in keys], list(counts.values()))
            kinds = (pa.int64(), pa.bool_(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "irregular", "token", "weight"])

    counted = source.select("text").mapInArrow(run, "key long, irregular boolean, token string, weight long")
    return counted.groupBy("key", "irregular", "token").agg(F.sum("weight").cast("double").alias("weight"))


def consistent_text(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", only_changed: bool = False) -> DataFrame:
    """(id, text, forms): every row's text in one consistent form and the irregular forms it held.

    Null text stays null and empty text empty, both without forms. One row out for each row in,
    repeated rows included; null ids stay. Other columns are not read, so their names cannot
    clash. An empty table gives an empty result. With only_changed, rows without forms are left
    out. Only texts that may hold a form are shuffled. The vocabulary is counted over all texts,
    in parts before the shuffle.
    """
    spark = df.sparkSession
    source = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))

    def only(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows(batches):
                yield batch.filter(pa.array([suspect(t) is wanted for t in batch.column(1).to_pylist()], pa.bool_()))

        return source.mapInArrow(run, source.schema)

    dirty = materialize(only(True).withColumn("_key", F.xxhash64("text")))
    counted = materialize(_counted(source))
    tokens = counted.where("irregular")
    vocabulary = counted.where((~F.col("irregular")) & (F.col("weight") >= KNOWN)).join(tokens.select("key").distinct(), "key", "left_semi")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(counted.count() / SHARD))
    shard = F.pmod("key", F.lit(shards)).cast("int").alias("shard")
    words = vocabulary.select(shard, F.col("token").alias("word"), "weight")
    spelled = match_in_shards(words, tokens.select(shard, "token", "weight"), _read, "token string, spelling string, marks int", shards)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            found = [(k, t) for k, text in zip(*(c.to_pylist() for c in batch.columns)) for t in dict.fromkeys(irregular_tokens(text))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())], ["_key", "token"])

    known = dirty.select("_key", "text").mapInArrow(pairs, "_key long, token string").join(spelled, "token")
    # One text's own tokens: bounded by the length of the text.
    known = known.groupBy("_key").agg(F.collect_set(F.struct("token", "spelling", "marks")).alias("_known"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            texts, forms = [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                new, held = normalize(text, {x["token"]: (x["spelling"], x["marks"]) for x in found or ()})
                texts.append(new)
                forms.append(held)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(forms, pa.list_(pa.string()))], ["id", "text", "forms"])

    schema = f"id {source.schema['id'].dataType.simpleString()}, text string, forms array<string>"
    fixed = dirty.join(known, "_key", "left").select("id", "text", "_known").mapInArrow(rewrite, schema)
    if only_changed:
        return fixed.where(F.size("forms") > 0).withColumnRenamed("id", id_column)
    clean = only(False).withColumn("forms", F.expr("cast(array() as array<string>)"))
    return clean.unionByName(fixed).withColumnRenamed("id", id_column)
