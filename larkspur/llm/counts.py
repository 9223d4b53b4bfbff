"""Token counts by merging, without identifiers.

A word starts as a linked list of symbols; the adjacent pair of lowest rank is
popped from a heap and merged until no pair is left. Its count is its symbols
minus its merges; the count of a text is the sum over its words. A special
token's string inside a text is one token. Null text counts as empty (0).
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import vocab
from .common import map_texts

#: Words that a worker process remembers.
CACHED_WORDS = 1_000_000


class Counter:
    def __init__(self, path: str):
        self.vocab = vocab.load(path)
        self.words = vocab.WordCache(self.count_word, CACHED_WORDS)

    def count_word(self, word: str) -> int:
        if word in self.vocab.specials:
            return 1
        symbols = self.vocab.byte_symbols(word)
        return len(symbols) - self.vocab.merge(symbols)

    def count(self, text: str) -> int:
        return sum(map(self.words.__getitem__, self.vocab.words(text)))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """keep's columns, n_bytes (UTF-8) and n_tokens of each text."""

    def kernel():
        count = counter(path).count
        return lambda texts: {
            "n_bytes": [len(t.encode()) for t in texts],
            "n_tokens": [count(t) for t in texts],
        }

    long = T.LongType()
    return map_texts(df, kernel, [T.StructField("n_bytes", long), T.StructField("n_tokens", long)], keep, text)
