"""A vocabulary trie and a weighted edit automaton that is run along it.

The automaton reads a written token and accepts vocabulary words at the sum of the costs of the
rules used. A state is the set of token positions reached, with the least cost of each and the
marks of the rules used on the way; it is carried down the trie, so words with a common start are
compared once, and a branch is left as soon as its state is empty. All words within the limit
are found.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A position's value: cost, number of rules used and their marks, in one number that is compared as a whole.
_COST, _USED, _MARKS = 1 << 40, 1 << 8, (1 << 8) - 1


class Rules:
    """What may stand for what; each rule has a whole cost and marks (bits below 256) that tell what it mends.

    single: written character -> {meant character: (cost, marks)}; multi: (written, meant, cost, marks)
    where one side has several characters; skip: written characters that stand for nothing -> marks.
    """

    def __init__(self, single: dict[str, dict[str, tuple[int, int]]], multi: Iterable[tuple[str, str, int, int]] = (), skip: dict[str, int] | None = None):
        self.single = {w: {m: (cost * _COST + _USED, marks) for m, (cost, marks) in some.items()} for w, some in single.items()}
        self.skip = {c: (_USED, marks) for c, marks in (skip or {}).items()}
        self.by_end: dict[str, list[tuple[str, str, int, int]]] = {}
        self.reach = 1
        for written, meant, cost, marks in multi:
            self.by_end.setdefault(meant[-1], []).append((written, meant, cost * _COST + _USED, marks))
            self.reach = max(self.reach, len(meant))


class Trie:
    def __init__(self, words: Iterable[tuple[str, float]]):
        self.root: dict = {}
        for word, weight in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = weight

    def match(self, token: str, rules: Rules, limit: int) -> list[tuple[str, float, int, int]]:
        """(word, weight, cost, marks) of every word that ``token`` may stand for at a cost within limit; of
        several ways to read a word the cheapest one counts, of those the one with the fewest rules."""
        end, found, most = len(token), [], (limit + 1) * _COST - 1
        single, by_end, reach = rules.single, rules.by_end, rules.reach

        def skipped(state: dict[int, int]) -> dict[int, int]:
            if rules.skip:
                for p in sorted(state):
                    while p < end and token[p] in rules.skip:
                        more, marks = rules.skip[token[p]]
                        value = (state[p] + more) | marks
                        if value >= state.get(p + 1, most + 1):
                            break
                        state[p + 1] = value
                        p += 1
            return state

        stack = [(self.root, "", [skipped({0: 0})])]
        while stack:
            node, path, states = stack.pop()
            now = states[-1]
            for c, child in node.items():
                if c == "":
                    if end in now:
                        found.append((path, child, now[end] // _COST, now[end] & _MARKS))
                    continue
                new: dict[int, int] = {}
                for p, value in now.items():
                    if p < end:
                        t = token[p]
                        if t != c:
                            rule = single.get(t)
                            if rule is None or c not in rule:
                                continue
                            more, marks = rule[c]
                            value = (value + more) | marks
                        if value <= most and value < new.get(p + 1, most + 1):
                            new[p + 1] = value
                word = path + c
                for written, meant, more, marks in by_end.get(c, ()):
                    if len(meant) <= len(states) and word.endswith(meant):
                        for p, value in states[-len(meant)].items():
                            value = (value + more) | marks
                            if value <= most and token.startswith(written, p) and value < new.get(p + len(written), most + 1):
                                new[p + len(written)] = value
                if new or any(states[1 - reach :] if reach > 1 else ()):
                    stack.append((child, word, [*states[1 - reach :], skipped(new)] if reach > 1 else [skipped(new)]))
        return found

    def near(self, token: str, sure: int) -> list[tuple[str, float]]:
        """(word, weight) of every word one edit (a letter replaced, left out or put in) away from the token
        whose first ``sure`` letters are those of the token.

        The Levenshtein automaton of distance one has two positions for each letter read: without an
        edit so far, where one path goes down the trie, and with the edit made, where the rest is fixed.
        """
        node = self.root
        for c in token[:sure]:
            if (node := node.get(c)) is None:
                return []
        found: dict[str, float] = {}

        def rest(node: dict, path: str, p: int) -> None:
            for c in token[p:]:
                if (node := node.get(c)) is None:
                    return
            if "" in node:
                found[path + token[p:]] = node[""]

        for p in range(sure, len(token) + 1):
            path = token[:p]
            if p < len(token):
                rest(node, path, p + 1)  # a letter too many
            for c, child in node.items():
                if c:
                    rest(child, path + c, p)  # a letter is missing
                    if p < len(token) and c != token[p]:
                        rest(child, path + c, p + 1)  # another letter
            if p == len(token) or (node := node.get(token[p])) is None:
                break
        found.pop(token, None)
        return list(found.items())


def shard_of(key: str, shards: int) -> int:
    return zlib.crc32(key.encode("utf-8", "surrogatepass")) % shards


def match_in_shards(vocabulary: DataFrame, tokens: DataFrame, find: Callable[[pd.DataFrame], Callable[[str, float], Iterable[tuple]]], schema: str, shards: int) -> DataFrame:
    """Read tokens against a vocabulary of any size.

    vocabulary: shard, word, ...; tokens: shard, token, weight. The shard of both comes from a key that
    all rules leave unchanged, so a token meets every word it may stand for in its own shard. What
    a shard needs of the vocabulary is all that a task holds. find(words) prepares a shard (say, as a
    trie) and gives the function that makes the output rows of a token. Shards are spread by their
    number, so that no task takes several because they are small.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(words: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(words) and len(asked):
            read = find(words)
            for token in asked.drop(columns="shard").itertuples(index=False):
                out.extend(read(*token))
        return pd.DataFrame(out, columns=names)

    tasks = min(shards, int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = [df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (vocabulary, tokens)]  # both may stem from one table
    spread = [df.repartition(tasks, "shard").groupBy("shard") for df in named]
    return spread[0].cogroup(spread[1]).applyInPandas(run, schema)


def count_in_parts(values: Iterator[Iterable[str]], most: int = 200_000) -> Iterator[dict[str, int]]:
    """Counts of values in parts of a bounded number of different ones."""
    counts: dict[str, int] = {}
    get = counts.get
    for some in values:
        for v in some:
            counts[v] = get(v, 0) + 1
        if len(counts) >= most:
            yield counts
            counts = {}
            get = counts.get
    if counts:
        yield counts
