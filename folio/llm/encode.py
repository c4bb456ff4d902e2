"""Problem 6: encoding of the whole corpus with a public byte-level BPE tokenizer.

Encoding is a reduction over a tree of text pieces. A leaf is encoded as it is; two
neighbouring results are joined by encoding a window around their border again. The window
grows, doubling, until both of its ends lie where the tokenizer's pre-splitting always
breaks, whatever stands further away: between a character that is no white space and a white
space. No alternative of the split pattern has white space after other characters, so a token
never crosses such a place and the tokens outside the window stay as they are. Hence the
result equals the encoding of the whole text at once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Characters of a leaf of the tree (a line of text), so that nearly every text is a tree of several.
LEAF = 96
#: Characters on either side of a border in the first window.
WINDOW = 16
#: The split pattern of byte_bpe_50k (fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: White space of the split pattern: the Unicode property White_Space (fixed value).
SPACE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


class TreeEncoder:
    """Encodes texts of any length; ``ranks`` is the tokenizer's file of ranks."""

    def __init__(self, ranks: bytes, leaf: int = LEAF, window: int = WINDOW):
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.size = {rank: len(token) for token, rank in table.items()}
        self.leaf, self.window = leaf, window
        self.joins = 0  # borders joined so far

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        # Neighbours are joined level by level, so no recursion depth is needed for any length.
        level = [(a, min(a + self.leaf, len(text))) for a in range(0, len(text), self.leaf)]
        level = [(a, b, self.encoding.encode_ordinary(text[a:b])) for a, b in level]
        while len(level) > 1:
            joined = [self._join(text, left, right) for left, right in zip(level[::2], level[1::2])]
            level = joined + level[len(joined) * 2 :]
        return level[0][2]

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode(ids)

    def _join(self, text: str, left: tuple, right: tuple) -> tuple:
        """The encoding of two neighbouring pieces: tokens near their border are made again from a window
        whose ends are certain breaks (or the ends of the pieces), all others are kept."""
        start, border, ids = left
        _, end, more = right
        reach = self.window
        while True:
            a = next((p for p in range(border - 1, max(start, border - reach), -1) if _breaks(text, p)), start)
            if a > start or border - reach <= start:
                break
            reach *= 2
        reach = self.window
        while True:
            b = next((p for p in range(border + 1, min(end, border + reach)) if _breaks(text, p)), end)
            if b < end or border + reach >= end:
                break
            reach *= 2
        size = self.size
        keep, cut = len(ids), len(text[a:border].encode())
        while cut > 0:
            keep -= 1
            cut -= size[ids[keep]]
        skip, cut = 0, len(text[border:b].encode())
        while cut > 0:
            cut -= size[more[skip]]
            skip += 1
        ids[keep:] = self.encoding.encode_ordinary(text[a:b])
        ids.extend(more[skip:] if skip else more)
        self.joins += 1
        return start, end, ids


def _breaks(text: str, p: int) -> bool:
    return text[p] in SPACE and text[p - 1] not in SPACE


@lru_cache(maxsize=2)
def _encoder(ranks: bytes) -> TreeEncoder:
    return TreeEncoder(ranks)


def ranks_of(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> bytes:
    with open(f"{folder}/{vocabulary}.tiktoken", "rb") as f:
        return f.read()


def encode_corpus(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids array<int>): the token ids of every row's text.

    Null and empty texts have an empty list. Repeated rows and null ids stay as they are: one row
    out for each row in. Other columns are not read, so their names cannot clash. An empty table
    gives an empty result. The only data sent to all executors is the tokenizer's file, whose
    size is fixed (about 1 MB).
    """
    ranks = df.sparkSession.sparkContext.broadcast(ranks_of(folder))
    source = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks.value).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [encode(t) if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    schema = f"id {source.schema['id'].dataType.simpleString()}, ids array<int>"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_column)
