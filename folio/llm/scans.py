"""Problem 2: readable text from scanned pages.

Three steps. Page furniture (headers, footers, page numbers) is what stands outermost on a page and
recurs on other pages, or numbers the page. Words broken at line ends are joined when the joined
word is one. Words that the corpus' native pages do not know are read by Levenshtein automata along
tries of those it knows: a weighted one with the usual confusions of scanners as its edits, and
the plain one of distance one, where any letter may be replaced, left out or put in. All
candidates are retrieved and ranked by cost, by their presence on the same page, and by frequency.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.durable import materialize
from folio.llm.automaton import Rules, Trie, count_in_parts, match_in_shards, shard_of
from folio.llm.words import rows

#: Occurrences that make a word known, and how much commoner than the misreading its source must be.
KNOWN, RATIO = 2, 3.0
#: Greatest cost of a misreading (one for each confusion), for words of up to three letters and longer ones.
LIMIT_SHORT, LIMIT = 1, 2
#: Cost of any other edit, letters of the shortest word that may hold one, and how much commoner its source must be.
EDIT, LEAST_LETTERS, EDIT_RATIO = 3.0, 5, 3.0
#: Words of the vocabulary in a shard.
SHARD = 50_000
#: Documents that repeat a line from page to page before it counts as furniture elsewhere, and their share.
TEMPLATE_DOCUMENTS, TEMPLATE_SHARE = 3, 0.2
#: Rows up to which the verdicts on words (about 60 bytes each) are sent to all executors; beyond, they are shuffled.
BROADCAST_ROWS = 200_000
#: Lines on either end of a page that are looked at first; where all are furniture, twice as many further ones are, and so on.
EDGE = 3

# What scanners confuse, as written:meant.
CONFUSIONS = (
    "f:e f:t t:f c:e c:o e:c o:c o:e e:o (:c 0:o 1:l 1:i l:i l:1 i:l |:l |:i !:i !:l j:i i:j 5:s s:5 9:g g:9 6:b b:6 8:b @:a b:h h:b v:y y:v u:v v:u n:u u:n 3:e "
    "rn:m m:rn nn:m m:nn ri:n n:ri li:h h:li cl:d d:cl ii:u u:ii vv:w w:vv w:vi vi:w in:m m:in ni:m m:ni iii:m m:iii"
)
HYPHENS = "-‐‑¬­"
_HYPHENS = frozenset(HYPHENS)

_LETTERS = r"[^\W\d_]+"
_NATIVE = re.compile(rf"{_LETTERS}(?:['’-]{_LETTERS})*")
_BROKEN = re.compile(rf"([^\W_@!|(]+(?:['’@!|(][^\W_]+)*)[{HYPHENS}]\s*$")
_NEXT = re.compile(r"\s*([^\W_]+(?:['’@!|(][^\W_]+)*)")
_NUMBER = re.compile(r"(?i)(?:\[[\dlo|]+\]|[-–] ?[\dlo|]+ ?[-–]|[\dlo|]{1,5}|[\dlo|]+ ?/ ?[\dlo|]+|p(?:[a@]g[ecf]|\.)? ?[\dlo|]+(?: [oc0][ft] [\dlo|]+)?|[ivxl]{1,6})$")
_PART = re.compile(r"[^\s\-‐‑–—/,.]+")
_GAP = re.compile(r"\s{3,}\S+(?: \S+){0,3}$")
_MIXED = re.compile(r"[\doOlI|!]+")


@lru_cache(maxsize=1)
def _rules() -> Rules:
    single: dict[str, dict[str, tuple[int, int]]] = {}
    multi = []
    for pair in CONFUSIONS.split():
        written, meant = pair.split(":")
        if len(written) == len(meant) == 1:
            single.setdefault(written, {})[meant] = (1, 0)
        else:
            multi.append((written, meant, 1, 0))
    return Rules(single, multi)


_FOLD = str.maketrans({**dict.fromkeys("mnriluhvwyjb1|!68", "i"), **dict.fromkeys("ecof0t(3", "o"), "d": "oi", "5": "s", "9": "g", "@": "a", "’": "'"})


def fold(word: str) -> str:
    """A key that no confusion changes: strokes are one sign however many, round letters another."""
    return re.sub("i+", "i", word.lower().translate(_FOLD))


def page_number(line: str) -> bool:
    return bool(_NUMBER.fullmatch(line.strip()))


def edge_lines(text: str, depth: int = 0, count: int = EDGE) -> list[tuple[str, int, int, str, str, bool]]:
    """(zone, place from the edge, line number, key, template, is a page number) of ``count`` lines from either edge,
    after ``depth`` outer ones."""
    lines = text.split("\n")
    filled = [i for i, line in enumerate(lines) if line.strip()]
    found = []
    for zone, some in (("top", filled[depth : depth + count]), ("bottom", filled[::-1][depth : depth + count])):
        for place, i in enumerate(some, depth):
            line = lines[i].strip()
            gap = _GAP.search(line)
            if gap and page_number(gap.group()):
                line = line[: gap.start()]
            key = "" if line[-1:] in ".!?,;:" or sum(c.isalpha() for c in line) < 4 else " ".join(sorted(fold(w) for w in re.findall(r"[^\W_]+", line)))
            template = re.sub(r"\d+", "#", line.lower()) if key else ""
            found.append((zone, place, i + 1, key, " ".join(fold(w) for w in template.split()), page_number(line)))
    return found


def broken_end(line: str) -> re.Match | None:
    """The last word of a line if it ends in a hyphen."""
    return _BROKEN.search(line) if line.rstrip()[-1:] in _HYPHENS else None


class Page:
    """The running text of a page: its lines, its words and where they stand."""

    def __init__(self, text: str, running: list[int], before: str | None, after: str | None):
        self.lines = text.split("\n")
        skip = set(running)
        self.body = [i for i, line in enumerate(self.lines, 1) if i not in skip and line.strip()]
        self.before, self.after = before, after
        self.broken: dict[int, tuple[str, str]] = {}  # line number -> fragment, continuation
        for n, i in enumerate(self.body):
            if m := broken_end(self.lines[i - 1]):
                follow = _NEXT.match(self.lines[self.body[n + 1] - 1]) if n + 1 < len(self.body) else None
                goes_on = follow.group(1) if follow else (after if n + 1 == len(self.body) else None)
                if goes_on:
                    self.broken[i] = (m.group(1), goes_on)

    @property
    def first(self) -> str | None:
        m = _NEXT.match(self.lines[self.body[0] - 1]) if self.body else None
        return m.group(1) if m else None

    @property
    def last(self) -> str | None:
        m = broken_end(self.lines[self.body[-1] - 1]) if self.body else None
        return m.group(1) if m else None

    def tokens(self) -> Iterator[tuple[int, str, int, int]]:
        """(line number, token, start, end) of the whole words of the body; parts of broken ones are left out."""
        previous = None
        for i in self.body:
            line = self.lines[i - 1]
            start = 0
            if previous in self.broken or (previous is None and self.before):
                m = _NEXT.match(line)
                start = m.end() if m else 0
            end = _BROKEN.search(line).start() if i in self.broken else len(line)
            for m in _PART.finditer(line, start, end):
                yield i, m.group(), m.start(), m.end()
            previous = i

    def joins(self) -> list[tuple[int | None, str, str]]:
        """(line number, fragment, continuation) of the words broken on this page, and None for the one before it."""
        found: list = [(i, a, b) for i, (a, b) in self.broken.items()]
        if self.before and self.first:
            found.append((None, self.before, self.first))
        return found

    def asked(self) -> set[str]:
        """Words whose verdicts are needed: '-word' asks whether a word is known, 'word' what it may mean."""
        found: set[str] = set()
        for token in {token for _, token, _, _ in self.tokens()}:
            found.update(look(token)[1])
        for _, a, b in self.joins():
            a, b = a.lower(), b.lower()
            found.update((f"-{a + b}", f"-{a}-{b}", f"-{a}", f"-{b}", a + b, a, b))
        return found


@lru_cache(maxsize=300_000)
def look(token: str) -> tuple[bool, tuple[str, ...]]:
    """Whether a token is a misread number, and its readings; tokens recur, so both are remembered."""
    return misread_number(token), tuple(readings(token))


def readings(token: str) -> list[str]:
    """The ways to take a token's outer signs; none for numbers."""
    low = token.lower()
    core = low.strip("()[]{}\"'“”„«»‘’;:!?*<>…·•|")
    if not any(c.isalpha() or c == "@" for c in low) or sum(c.isdigit() for c in core) > sum(c.isalpha() for c in core):
        return []
    found = [core] if core else []
    left = low[: low.find(core)] if core else low
    right = low[len(left) + len(core) :]
    if left[-1:] in ("(", "|", "!") and left:
        found.append(left[-1] + core)
    if right[:1] in ("|", "!", "(") and right:
        found.append(core + right[0])
    return found


def misread_number(token: str) -> bool:
    """Digits among which letters stand that look like digits."""
    core = token.strip("()[]\"';:!?")
    if not _MIXED.fullmatch(core):
        return False
    digits = sum(c.isdigit() for c in core)
    return digits >= 2 and digits < len(core) and digits > len(core) // 2


class Verdicts:
    """What is known of the words of one page. meant: word -> candidates (word, cost, count)."""

    def __init__(self, known: dict[str, float], meant: dict[str, list[tuple[str, float, float]]], page: Page):
        self.known, self.meant, self.page = known, meant, page
        self.on_page: set[str] | None = None

    def best(self, word: str, most: float = EDIT) -> str | None:
        found = [x for x in self.meant.get(word, ()) if x[1] <= most]
        if not found:
            return None
        if len(found) > 1 and self.on_page is None:
            self.on_page = {word for _, token, _, _ in self.page.tokens() for word in look(token)[1]}
        return min(found, key=lambda x: (x[1], x[0] not in (self.on_page or ()), -x[2], x[0]))[0]

    def join(self, a: str, b: str) -> tuple[bool, str | None]:
        """Whether fragment and continuation are one word, and which if it was misread."""
        a, b = a.lower(), b.lower()
        one, two = self.known.get(a + b, 0.0), self.known.get(f"{a}-{b}", 0.0)
        if one or two:
            return one >= two, None
        if meant := self.best(a + b, LIMIT):
            return True, meant
        # Neither is known: two whole words are a word with its hyphen, anything else was broken.
        whole = all(self.known.get(x) or self.best(x, LIMIT) for x in (a, b))
        return not whole, None if whole else self.best(a + b)


def repair(page: Page, verdicts: Verdicts) -> tuple[str, list[tuple[int, str]]]:
    """The readable text of the page and its problems (line number, hyphen or misread)."""
    problems: set[tuple[int, str]] = set()
    changes: dict[int, list[tuple[int, int, str]]] = {}
    for i, token, start, end in page.tokens():
        number, words = look(token)
        if number:
            problems.add((i, "misread"))
            changes.setdefault(i, []).append((start, end, token.translate(str.maketrans("oOlI|!", "001111"))))
            continue
        for reading in words:
            if reading in verdicts.meant and (meant := verdicts.best(reading)):
                problems.add((i, "misread"))
                at = token.lower().find(reading)
                changes.setdefault(i, []).append((start + at, start + at + len(reading), cased(meant, token[at : at + len(reading)])))
                break
    ends: dict[int, tuple[str, bool]] = {}
    cut_first = False
    for i, a, b in page.joins():
        one, meant = verdicts.join(a, b)
        sides = [(a, True), (b, False)]
        if one:
            wrong_a = bool(meant) and not meant.startswith(a.lower())
            wrong_b = bool(meant) and not meant.endswith(b.lower())
            if meant and not (wrong_a or wrong_b):
                wrong_a = True
            written = cased(meant, a + b) if meant else a + b
        else:
            fixed = [verdicts.best(x.lower(), LIMIT) for x, _ in sides]
            wrong_a, wrong_b = (f is not None for f in fixed)
            written = "-".join(cased(f, x) if f else x for f, (x, _) in zip(fixed, sides))
        if i is None:
            cut_first = True
            if wrong_b:
                problems.add((page.body[0], "misread"))
            continue
        ends[i] = (written, one)
        if one:
            problems.add((i, "hyphen"))
        if wrong_a:
            problems.add((i, "misread"))
        place = page.body.index(i)
        if wrong_b and place + 1 < len(page.body):
            problems.add((page.body[place + 1], "misread"))
    paragraphs: list[list[str]] = [[]]
    previous, body = None, set(page.body)
    for i, line in enumerate(page.lines, 1):
        if i not in body:
            if not line.strip() and paragraphs[-1] and previous not in ends:
                paragraphs.append([])
            continue
        start, stop = 0, len(line)
        if previous in ends or (previous is None and cut_first):
            start = _NEXT.match(line).end()
        if i in ends:
            stop = _BROKEN.search(line).start()
        out, at = [], start
        for a, b, new in sorted(changes.get(i, ())):
            out += [line[at:a], new]
            at = b
        out.append(line[at:stop])
        text = "".join(out).strip()
        if i in ends:
            text = f"{text} {ends[i][0]}".strip()
        if start and paragraphs[-1] and text[:1] in ".,;:!?)" and text:
            paragraphs[-1][-1] += text
        elif text:
            paragraphs[-1].append(text)
        previous = i
    return "\n\n".join(" ".join(p) for p in paragraphs if p), sorted(problems)


def cased(word: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


def _running(pages: DataFrame) -> DataFrame:
    """document_id, page, running (line numbers of furniture) of the pages that have any."""

    def edges(depth: int, count: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows(batches):
                out: list[list] = [[] for _ in range(8)]
                for document, page, text in zip(*(c.to_pylist() for c in batch.columns)):
                    for row in edge_lines(text, depth, count):
                        for column, value in zip(out, (document, page, *row)):
                            column.append(value)
                kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["document_id", "page", "zone", "place", "line_no", "key", "template", "number"])

        return run

    schema = "document_id string, page int, zone string, place int, line_no int, key string, template string, number boolean"
    found, full, depth, count = None, None, 0, EDGE
    while True:
        some = pages if full is None else pages.join(full.select("document_id", "page").distinct(), ["document_id", "page"], "left_semi")
        edge = some.select("document_id", "page", "text").mapInArrow(edges(depth, count), schema)
        if full is not None:
            edge = edge.join(full, ["document_id", "page", "zone"], "left_semi")
        zones = _zones(materialize(edge))
        found = zones if found is None else found.unionByName(zones)
        full = zones.where(F.size("lines") == count).select("document_id", "page", "zone")
        if not full.limit(1).count():
            break
        full, depth, count = materialize(full), depth + count, 2 * count
    return found.groupBy("document_id", "page").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("running")).where(F.size("running") > 0)


def _zones(edge: DataFrame) -> DataFrame:
    """document_id, page, zone, lines (line numbers of furniture among the lines looked at)."""
    keyed = edge.where("key <> ''")
    repeated = keyed.groupBy("document_id", "zone", "key").agg(F.count_distinct("page").alias("pages"), F.first("template").alias("template"))
    repeated = materialize(repeated)
    # Lines that many documents repeat from page to page count in single pages too.
    templates = repeated.groupBy("zone", "template").agg(F.count("*").alias("seen"), F.count_if(F.col("pages") > 1).alias("recurring"))
    templates = templates.where((F.col("recurring") >= TEMPLATE_DOCUMENTS) & (F.col("recurring") >= TEMPLATE_SHARE * F.col("seen")))
    own = repeated.where("pages > 1").select("document_id", "zone", "key", F.lit(True).alias("own"))
    marked = edge.join(own, ["document_id", "zone", "key"], "left").join(templates.select("zone", "template", F.lit(True).alias("common")), ["zone", "template"], "left")
    marked = marked.withColumn("is", F.coalesce("own", F.lit(False)) | F.coalesce("common", F.lit(False)) | F.col("number"))
    # Furniture stands outermost: a line counts only if all lines farther out do.
    ordered = F.array_sort(F.collect_list(F.struct("place", "line_no", "is")))
    zones = marked.groupBy("document_id", "page", "zone").agg(ordered.alias("e"))
    outer = F.filter("e", lambda x: ~F.exists("e", lambda y: (y["place"] <= x["place"]) & ~y["is"]))
    return materialize(zones.select("document_id", "page", "zone", F.transform(outer, lambda x: x["line_no"]).alias("lines")).where(F.size("lines") > 0))


def _native_counts(pages: DataFrame) -> DataFrame:
    """word, count over all pages that were not scanned."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(text: str) -> list[str]:
            words = _NATIVE.findall(text.lower())
            return words + [part for w in words if "-" in w for part in w.split("-")]

        for counts in count_in_parts(found(t) for b in batches for t in b.column(0).to_pylist() if t):
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "count"])

    return pages.select("text").mapInArrow(count, "word string, count long").groupBy("word").agg(F.sum("count").alias("count"))


def repair_scans(pages: DataFrame) -> DataFrame:
    """(document_id, page, text, problems): each scanned page's running text in paragraphs, and what was wrong
    by line (line_no, problem): running, hyphen, misread. A word that goes on overleaf is on the first page.

    pages: document_id, page, kind, text; scanned are those of kind ocr, the others give the words that
    are known. Of several rows of a page the one with the least text counts (copies are equal).
    Null text counts as empty; rows with a null document_id or page are left out. Without native pages
    no word is known, so only furniture, hyphens and digits are repaired. Other columns are not
    read; an empty table gives an empty result. Corpus counts are taken over all pages, in parts
    before the shuffle. Words are matched in shards by a key that no confusion changes.
    """
    spark = pages.sparkSession
    source = pages.select(F.col("document_id").cast("string").alias("document_id"), F.col("page").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("kind", F.lit("")).alias("kind"))
    scanned = source.where("kind = 'ocr' AND document_id IS NOT NULL AND page IS NOT NULL")
    scanned = materialize(scanned.groupBy("document_id", "page").agg(F.min("text").alias("text")))
    running = materialize(_running(scanned))
    sides = scanned.join(running, ["document_id", "page"], "left")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            some = [Page(t, r or [], None, None) for t, r in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            columns = [batch.column(0), batch.column(1), pa.array([p.first for p in some], pa.string()), pa.array([p.last for p in some], pa.string()), pa.array([bool(p.body) for p in some], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["document_id", "page", "first", "last", "filled"])

    order = Window.partitionBy("document_id").orderBy("page")
    narrow = sides.select("document_id", "page", "text", "running").mapInArrow(bounds, "document_id string, page int, first string, last string, filled boolean").where("filled")
    narrow = narrow.withColumn("after", F.lead("first").over(order)).withColumn("before", F.lag("last").over(order))
    narrow = narrow.withColumn("before", F.when(F.col("first").isNotNull(), F.col("before")))
    whole = materialize(sides.join(narrow.select("document_id", "page", "before", "after"), ["document_id", "page"], "left"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            asked = [sorted(Page(*x).asked()) for x in zip(*(c.to_pylist() or [] for c in batch.columns[2:]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(asked, pa.list_(pa.string()))], ["document_id", "page", "asked"])

    empty = F.expr("cast(array() as array<int>)")
    input_columns = ["document_id", "page", "text", F.coalesce("running", empty).alias("running"), "before", "after"]
    asked = whole.select(*input_columns).mapInArrow(ask, "document_id string, page int, asked array<string>")
    asked = materialize(asked)  # asked for twice
    asked = asked.select("document_id", "page", F.explode("asked").alias("asked"))
    wanted = asked.groupBy("asked").agg(F.count("*").alias("times"))
    native = materialize(_native_counts(source.where("kind <> 'ocr'")).where(F.col("count") >= KNOWN))
    wanted = wanted.withColumn("word", F.regexp_replace("asked", "^-", "")).withColumn("exists", F.col("asked").startswith("-"))
    judged = materialize(wanted.join(native, "word", "left"))

    shards = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(native.count() / SHARD))

    def keyed(keys, column: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places, kinds, shard = [], [], []
                for n, word in enumerate(batch.column(0).to_pylist()):
                    for key in keys(word):
                        places.append(n)
                        kinds.append(key[0])
                        shard.append(shard_of(key, shards))
                at = pa.array(places, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(kinds, pa.string()), batch.column(0).take(at), batch.column(1).take(at)], ["shard", "kind", column, "weight"])

        return run

    vocabulary = native.select("word", F.col("count").cast("double")).mapInArrow(keyed(word_keys, "word"), "shard int, kind string, word string, weight double").distinct()
    unknown = judged.where("NOT exists AND count IS NULL").select("word", F.col("times").cast("double"))
    tokens = unknown.mapInArrow(keyed(token_keys, "token"), "shard int, kind string, token string, weight double")
    meant = match_in_shards(vocabulary, tokens, _reader, "asked string, meant string, cost double, seen double", shards)
    meant = meant.groupBy("asked", "meant", "seen").agg(F.min("cost").alias("cost"))
    meant = meant.groupBy("asked").agg(F.collect_list(F.struct("meant", "cost", "seen")).alias("meant"))
    exist = judged.where("exists AND count IS NOT NULL").select("asked", F.array(F.struct(F.lit("").alias("meant"), F.lit(0.0).alias("cost"), F.col("count").cast("double").alias("seen"))).alias("meant"))
    verdicts = materialize(meant.unionByName(exist))
    small = verdicts.count() <= BROADCAST_ROWS
    told = asked.join(F.broadcast(verdicts) if small else verdicts, "asked")
    told = told.groupBy("document_id", "page").agg(F.collect_list(F.struct("asked", "meant")).alias("told"))  # one page's words

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("line_no", pa.int32()), ("problem", pa.string())]))
        for batch in rows(batches):
            texts, problems = [], []
            for text, skip, before, after, told_of in zip(*(c.to_pylist() for c in batch.columns[2:])):
                page = Page(text, skip, before, after)
                known, means = {}, {}
                for row in told_of or ():
                    if row["asked"].startswith("-"):
                        known[row["asked"][1:]] = row["meant"][0]["seen"]
                    else:
                        means[row["asked"]] = [(m["meant"], m["cost"], m["seen"]) for m in row["meant"]]
                new, found = repair(page, Verdicts(known, means, page))
                texts.append(new)
                problems.append([{"line_no": n, "problem": p} for n, p in sorted([*((n, "running") for n in skip), *found])])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(problems, kind)], ["document_id", "page", "text", "problems"])

    ready = whole.select(*input_columns).join(told, ["document_id", "page"], "left")
    return ready.mapInArrow(mend, "document_id string, page int, text string, problems array<struct<line_no:int,problem:string>>")


def token_keys(token: str) -> list[str]:
    """Keys of a token: it shares the first with all words that confusions make of it; a word that is one other
    edit away has either its first half or its second half unchanged. A reading that takes in an outer sign
    (``word!`` for a last letter l) is a confusion or nothing."""
    half = len(token) // 2
    edited = len(token) >= LEAST_LETTERS and token[0].isalpha() and token[-1].isalpha()
    return [f"c{fold(token)}", *((f"<{token[:half]}", f">{token[half:]}") if edited else ())]


def word_keys(word: str) -> list[str]:
    """Keys of a word: those of all tokens that may stand for it (one letter shorter, as long, or one longer)."""
    found = {f"c{fold(word)}"}
    for n in range(max(LEAST_LETTERS, len(word) - 1), len(word) + 2):
        found.update((f"<{word[: n // 2]}", f">{word[-(n - n // 2) :]}"))
    return sorted(found)


def _reader(words) -> Callable[[str, str, float], list[tuple[str, str, float, float]]]:
    """The automata over a shard's words: all words that a token may stand for and that are clearly commoner."""
    by = {kind: list(zip(some["word"], some["weight"])) for kind, some in words.groupby("kind")}
    confused, fore, back = Trie(by.get("c", ())), Trie(by.get("<", ())), Trie((w[::-1], n) for w, n in by.get(">", ()))
    rules = _rules()

    def read(kind: str, token: str, times: float) -> list[tuple[str, str, float, float]]:
        if kind == "c":
            found = confused.match(token, rules, LIMIT_SHORT if len(token) <= 3 else LIMIT)
            return [(token, meant, float(cost), seen) for meant, seen, cost, _ in found if cost > 0 and seen >= RATIO * times]
        half = len(token) // 2
        near = fore.near(token, half) if kind == "<" else [(w[::-1], n) for w, n in back.near(token[::-1], len(token) - half)]
        return [(token, meant, EDIT, seen) for meant, seen in near if seen >= EDIT_RATIO * times]

    return read
