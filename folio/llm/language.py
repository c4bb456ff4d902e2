"""Problem 3: the language of documents and of the segments of mixed documents.

The script of a word narrows the languages it may be in; within them a model of whole words and
of character sequences scores it. A Viterbi search over the words of a text, with a penalty for
each switch of language (a small one where a paragraph begins), labels spans.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.words import WORD, rows

#: Greatest number of labelled samples that the model is fitted on.
MOST_SAMPLES = 20_000
#: Greatest number, and length, of labelled documents that it is then refined on.
MOST_TEXTS, MOST_CHARS = 2_000, 20_000
#: Penalties of a switch inside a paragraph and at its start; greatest loss of one word.
SWITCH, SWITCH_AT_PARAGRAPH, FLOOR = 8.0, 2.0, 5.0
#: Words of the texts that are searched side by side (bounds the memory of a task; a longer text is searched alone).
CELLS = 131_072
LEAST_WORDS = 8
UNKNOWN = "und"

# Common function words, scripts by code range, and names of languages.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are with as at be this have from or by not but which their has will each any every our one",
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch dem an werden aus er hat dass sie nach bei um am wird",
    "fr": "le la les de des et à un une du en est que pour dans qui sur pas au par avec ce il sont ne se plus ou mais cette aux sans",
    "es": "el la los las de que y en un una por con para no es se del al lo como más pero sus su le ya o este sí porque esta entre sin",
    "it": "il lo la i gli le di che e è un una in per con non del della dei si da al alla come più ma anche nel sono dal questa questo senza",
    "nl": "de het een en van in is dat op te met voor zijn niet aan er door om bij ook naar uit dan nog wordt deze worden heeft tot ze zonder",
    "pt": "o a os as de que e em um uma do da dos das no na para com não se por mais ao é como mas foi à ou sem pelo pela seu sua este esta",
    "ru": "и в не на что с по как это к из для у за от но о же до при или был его все так бы только они мы без уже после",
    "el": "και το της του η να την των για με στο από τα τον που σε δεν είναι ότι οι στη τις στην θα μας τους μια κατά ή χωρίς ο",
}
SCRIPTS = {"latin": "A-Za-zÀ-ɏḀ-ỿ", "greek": "Ͱ-Ͽἀ-῿", "cyrillic": "Ѐ-ԯ"}
NAMES = {
    "en": "english eng", "de": "german deutsch ger deu", "fr": "french français fra fre", "es": "spanish español spa", "it": "italian italiano ita",
    "nl": "dutch nederlands dut nld", "pt": "portuguese português por", "ru": "russian русский rus", "el": "greek ελληνικά gre ell",
}


#: A string of code: so many characters without white space. Its words are in no language.
_CODE = re.compile(r"\S{40,}")


def _as_code(m: re.Match) -> str:
    return " a0" * len(WORD.findall(m.group()))


class LanguageModel:
    """Scores of words by language, fitted on word counts by language."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.languages = sorted(counts)
        self.words, self.grams, self.totals = [], [], []
        letters = set()
        for language in self.languages:
            known = Counter(counts[language])
            for w in FUNCTION_WORDS.get(language, "").split():
                known[w] += 3
            self.words.append(known)
            self.totals.append(known.total() + 1)
            grams: Counter = Counter()
            for w, times in known.items():
                for g in _grams(w):
                    grams[g] += min(times, 8)
                    grams[g[:-1], "*"] += min(times, 8)
            self.grams.append(grams)
            letters |= set("".join(known))
        self.letters = max(30, len(letters))
        self.scripts = []
        for language in self.languages:
            all_text = "".join(counts[language])
            held = {s: len(re.findall(f"[{r}]", all_text)) for s, r in SCRIPTS.items()}
            self.scripts.append({s for s, n in held.items() if n > 0.2 * max(1, len(all_text))})
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, max(1, len(self.languages))), np.float32)
        self.counted = np.zeros(1024, bool)

    def number(self, word: str) -> int:
        """Row of the score table for a word as written."""
        at = self.known.get(word)
        if at is None:
            if len(self.known) > 400_000:
                self.known.clear()
            at = self.known[word] = len(self.known)
            if at >= len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
                self.counted = np.concatenate([self.counted, np.zeros_like(self.counted)])
            self.table[at], self.counted[at] = self._score(word)
        return at

    def _score(self, word: str) -> tuple[np.ndarray, bool]:
        """Loss of each language against the best one, and whether the word counts at all."""
        n = len(self.languages)
        plain = unicodedata.normalize("NFKC", word).lower()
        digits = bool(re.search(r"\d", plain))
        if not n or digits or len(plain) > 30:  # numbers, codes and strings of code are in no language
            return np.zeros(max(1, n), np.float32), bool(n) and plain.isdigit()
        held = {s: len(re.findall(f"[{r}]", plain)) for s, r in SCRIPTS.items()}
        script = max(held, key=lambda s: held[s])
        inside = [held[script] > 0 and script in scripts for scripts in self.scripts]
        if not any(inside):
            return np.zeros(n, np.float32), False
        score, seen = np.full(n, -np.inf), False
        for k in range(n):
            if inside[k]:
                words, grams = self.words[k], self.grams[k]
                whole = words[plain] / self.totals[k]
                seen = seen or words[plain] > 0
                spelled = 0.0
                for g in _grams(plain):
                    # Witten-Bell style: longest context first, an even chance at the end.
                    p, weight = 0.0, 1.0
                    for cut in range(len(g) - 1, -1, -1):
                        context, full = grams[g[:-1][len(g) - 1 - cut :], "*"], grams[g[len(g) - 1 - cut :]] if cut else 0
                        if context and cut:
                            share = context / (context + 3.0)
                            p += weight * share * full / context
                            weight *= 1 - share
                    p += weight / self.letters
                    spelled += math.log(p)
                score[k] = math.log(0.5 * whole + 0.5 * math.exp(spelled) + 1e-30)
        score -= score.max()
        best = np.maximum(score, -FLOOR)
        if not seen:  # a name or a rare word: a hint only
            best *= 0.3 if word[:1].isupper() else 0.6
        best[~np.array(inside)] = -FLOOR
        return best.astype(np.float32), True

    def label(self, texts: list[str]) -> list[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
        """For each text its paragraphs: number, word count by language, summed scores by language, words."""
        n = max(1, len(self.languages))
        words, starts, marks = [], [], []
        for text in texts:
            ids: list[int] = []
            first, spans = [], []
            for number, paragraph in enumerate(text.split("\n\n"), 1):
                found = WORD.findall(_CODE.sub(_as_code, paragraph))
                if found:
                    spans.append((number, len(ids), len(ids) + len(found)))
                    first.append(len(ids))
                    ids.extend(map(self.number, found))
            words.append(np.array(ids, np.int64))
            starts.append(first)
            marks.append(spans)
        labels: list[np.ndarray] = [np.empty(0, np.int8)] * len(texts)
        order = sorted((k for k in range(len(texts)) if len(words[k])), key=lambda k: -len(words[k]))
        while order:
            longest = len(words[order[0]])
            some = order[: max(1, CELLS // longest)]
            order = order[len(some) :]
            ids = np.zeros((len(some), longest), np.int64)
            real = np.zeros((len(some), longest), bool)
            penalty = np.full((len(some), longest), SWITCH, np.float32)
            for row, k in enumerate(some):
                ids[row, : len(words[k])] = words[k]
                real[row, : len(words[k])] = True
                penalty[row, starts[k]] = SWITCH_AT_PARAGRAPH
            found = self._viterbi(ids, real, penalty)
            for row, k in enumerate(some):
                labels[k] = found[row, : len(words[k])]
        out = []
        for ids, mine, spans in zip(words, labels, marks):
            paragraphs = []
            for number, a, b in spans:
                counted = self.counted[ids[a:b]]
                paragraphs.append((number, np.bincount(mine[a:b][counted], minlength=n), self.table[ids[a:b]].sum(0), b - a))
            out.append(paragraphs)
        return out

    def _viterbi(self, ids: np.ndarray, real: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        count, longest = ids.shape
        n = self.table.shape[1]
        back = np.zeros((longest, count, n), np.int8)
        stay = np.arange(n, dtype=np.int8)
        value = self.table[ids[:, 0]].copy()
        for t in range(1, longest):
            best = value.argmax(1)
            other = value[np.arange(count), best] - penalty[:, t]
            switch = other[:, None] > value
            back[t] = np.where(switch, best[:, None], stay)
            step = np.where(switch, other[:, None], value) + self.table[ids[:, t]]
            value = np.where(real[:, t, None], step, value)
            back[t][~real[:, t]] = stay
        labels = np.zeros((count, longest), np.int8)
        now = value.argmax(1).astype(np.int8)
        for t in range(longest - 1, -1, -1):
            labels[:, t] = now
            now = back[t][np.arange(count), now]
        return labels


def word_counts(samples: list[tuple[str, str]]) -> dict[str, dict[str, int]]:
    """Words by language; where there are many texts, words that are always capitalised (names) are left out."""
    counts: dict[str, Counter] = {}
    for language, text in samples:
        counts.setdefault(language, Counter()).update(w for w in WORD.findall(text) if not re.search(r"\d", w))
    out = {}
    for language, held in counts.items():
        lower: Counter = Counter()
        for w, n in held.items():
            lower[w.lower()] += n
        out[language] = {w: n for w, n in lower.items() if held[w] or n >= 20}
    return out


def fit(samples: list[tuple[str, str]], texts: list[tuple[str, str]]) -> dict[str, dict[str, int]]:
    """Word counts for the model: of the samples, and of those paragraphs of (text, stored label) that
    a model of the samples alone is sure of, in texts whose label agrees."""
    first = LanguageModel(word_counts(samples))
    sure: list[tuple[str, str]] = []
    for (text, label), paragraphs in zip(texts, first.label([t for t, _ in texts])):
        parts = text.split("\n\n")
        for number, counts, scores, n in paragraphs:
            language, confidence = _judged(counts, scores, first.languages)
            if n >= LEAST_WORDS and confidence >= 0.95 and _code_of(label, first.languages) == language:
                sure.append((language, parts[number - 1]))
    return word_counts([*[(k, f"{t.lower()}") for k, t in samples], *sure])


def _grams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[max(0, i - 3) : i + 1] for i in range(1, len(padded))]


def _judged(counts: np.ndarray, scores: np.ndarray, languages: list[str]) -> tuple[str, float]:
    total = int(counts.sum())
    if not total or not languages:
        return UNKNOWN, 0.0
    best = int(counts.argmax())
    rest = np.delete(scores, best).max() if len(scores) > 1 else scores[best] - 20.0
    margin = float(scores[best] - rest)
    return languages[best], round(float(counts[best]) / total / (1 + math.exp(-max(-30.0, min(30.0, margin)))), 4)


@lru_cache(maxsize=2)
def _model(packed: bytes) -> LanguageModel:
    import pickle

    return LanguageModel(pickle.loads(packed))


def _code_of(stored: str | None, languages: list[str]) -> str | None:
    """The language that a stored label names; letter case and a region don't matter."""
    if not stored:
        return None
    bare = re.split(r"[-_]", stored.strip().lower())[0]
    return next((code for code in languages if bare == code or bare in NAMES.get(code, "").split()), None)


def identify(documents: DataFrame, samples: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "language") -> DataFrame:
    """(id, seg_no, language, confidence, n_words, stored_ok, main): seg_no 0 is the whole text; a text that mixes
    languages has a further row for each paragraph with words (numbered from 1, split at two newlines).
    main is the language of the whole text, on each of its rows.

    A text or paragraph whose words are in no language of the samples (numbers, codes, strings of
    code, other scripts), null and empty texts included, has the language 'und' and confidence 0.
    stored_ok tells for seg_no 0 whether the stored label names the language found; null elsewhere.
    Every row of the input is labelled, repeated rows too; other columns are not read. Without
    samples everything is 'und'. The model is fitted on at most MOST_SAMPLES labelled sentences (the
    first by text) and on paragraphs of at most MOST_TEXTS labelled documents (the first by hash) of
    at most MOST_CHARS characters; its word counts are all that is sent to the executors. It labels
    whole texts of all rows.
    """
    import pickle

    spark = documents.sparkSession
    fitted = samples.select("language", "text").where("language IS NOT NULL AND text IS NOT NULL").orderBy("text", "language").limit(MOST_SAMPLES)
    source = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), F.col(label_column).cast("string").alias("stored"))
    labelled = source.where(F.col("stored").isNotNull() & F.length("text").between(LEAST_WORDS, MOST_CHARS)).withColumn("h", F.xxhash64("text"))
    # The bound is found on hashes alone, so no task sends texts that are not used.
    least = labelled.select("h").distinct().orderBy("h").limit(MOST_TEXTS).agg(F.max("h")).first()[0]
    chosen = labelled.where(F.col("h") <= F.lit(least)).groupBy("h").agg(F.min(F.struct("text", "stored")).alias("x")).select("x.*") if least is not None else None
    counts = fit([(r["language"], r["text"]) for r in fitted.collect()], sorted((r["text"], r["stored"]) for r in chosen.collect()) if chosen is not None else [])
    packed = spark.sparkContext.broadcast(pickle.dumps(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(packed.value)
        names = model.languages
        for batch in rows(batches, 1000):
            ids, texts, stored = (c.to_pylist() for c in batch.columns)
            out: list[list] = [[] for _ in range(7)]
            for key, label, paragraphs in zip(ids, stored, model.label([t or "" for t in texts])):
                counts = sum((p[1] for p in paragraphs), np.zeros(max(1, len(names)), np.int64))
                scores = sum((p[2] for p in paragraphs), np.zeros(max(1, len(names)), np.float32))
                main, sure = _judged(counts, scores, names)
                found = [(0, main, sure, sum(p[3] for p in paragraphs), _code_of(label, names) == main)]
                parts = [(p[0], *_judged(p[1], p[2], names), p[3], None) for p in paragraphs]
                if any(p[1] not in (main, UNKNOWN) for p in parts):
                    found += parts
                for row in found:
                    for column, value in zip(out, (key, *row, main)):
                        column.append(value)
            kinds = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["id", "seg_no", "language", "confidence", "n_words", "stored_ok", "main"])

    kind = source.schema["id"].dataType.simpleString()
    found = source.mapInArrow(run, f"id {kind}, seg_no int, language string, confidence double, n_words int, stored_ok boolean, main string")
    return found.withColumnRenamed("id", id_column)


def cases(found: DataFrame, id_column: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, seg_no, language): documents whose stored label is missing or wrong, and paragraphs in
    another language than their document's main one, each of at least ``least_words`` words."""
    case = F.when(F.col("seg_no") == 0, ~F.col("stored_ok")).otherwise(F.col("language") != F.col("main"))
    return found.where((F.col("n_words") >= least_words) & (F.col("language") != UNKNOWN) & case).select(id_column, "seg_no", "language").distinct()
