"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token with which the encoding
of that prefix ends. It is found among the tokens that are suffixes of the
prefix (matched by an automaton over all tokens) as the one that is compatible
with the last token of what stands before it: merging the two tokens' symbols
together would give the same two tokens again. Following the stored last
tokens backwards gives the identifiers. Time is linear in the word for a
bounded number of tokens that end at one place; there is no merge queue.

Null text counts as empty; empty text has no identifiers and decodes to "".
Repeated rows are encoded each by itself; other columns pass through.
"""

from __future__ import annotations

import functools
from itertools import chain

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import vocab
from .common import map_texts

#: Words and pairs that a worker process remembers.
CACHED_WORDS, CACHED_PAIRS = 400_000, 1_000_000


class PrefixEncoder:
    def __init__(self, path: str):
        self.vocab = v = vocab.load(path)
        self.length: dict[int, int] = {}
        self.matches = ahocorasick.Automaton()
        for token, symbols in v.spelled.items():
            if len(v.merge_down(symbols)[0]) == 1:  # others never come out of merging
                self.length[token] = len(symbols)
                self.matches.add_word(symbols, token)
        self.matches.make_automaton()
        self.pairs = vocab.WordCache(self._compatible, CACHED_PAIRS)
        self.words = vocab.WordCache(self.encode_word, CACHED_WORDS)

    def _compatible(self, pair: int) -> bool:
        """Whether merging keeps the border between two tokens.

        Their merges are undone from the last to the first. While two parts
        touch at the border, a merge of the two must not come before the merge
        that takes one of them away; of equal ranks the left one comes first.
        """
        left, right = pair >> vocab.BITS, pair & vocab.MASK
        rank, parts, merges = self.vocab.rank, self.vocab.parts, self.vocab.merges
        before = 1 << 60
        while True:
            joined = merges.get(left << vocab.BITS | right)
            if joined is not None and joined >> vocab.BITS < before:
                return False
            if rank[left] > rank[right]:
                before = rank[left]
                left = parts[left][1]
            elif rank[right] >= 0:
                before = rank[right] + 1
                right = parts[right][0]
            else:
                return True

    def encode_word(self, word: str) -> tuple[int, ...]:
        v = self.vocab
        if word in v.specials:
            return (v.specials[word],)
        symbols = v.spell(word)
        length, pairs = self.length, self.pairs
        last = [-1] * len(symbols)
        for end, token in self.matches.iter(symbols):
            if last[end] < 0:
                at = end - length[token]
                if at < 0 or pairs[last[at] << vocab.BITS | token]:
                    last[end] = token
        out, end = [], len(symbols) - 1
        while end >= 0:
            out.append(last[end])
            end -= length[last[end]]
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.vocab.words(text))))

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by a space for word-end vocabularies (their
        files name no decoder), else the bytes that the tokens stand for;
        unknown identifiers are left out."""
        strings = self.vocab.text_of
        if self.vocab.suffix:
            try:
                return " ".join(map(strings.__getitem__, ids))
            except KeyError:
                return " ".join(strings[i] for i in ids if i in strings)
        back = {c: b for b, c in vocab.byte_alphabet().items()}
        raw = bytearray()
        for i in ids:
            s = strings.get(i, "")
            raw += s.encode() if s in self.vocab.specials else bytes(back[c] for c in s)
        return raw.decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def encode(df: DataFrame, path: str, keep: list[str], text: str = "text", decoded: bool = False) -> DataFrame:
    """keep's columns, ids array<int> of each text and, if asked for, their decoded string."""

    def kernel():
        enc = encoder(path)

        def run(texts):
            ids = [enc.encode(t) for t in texts]
            return {"ids": ids} | ({"decoded": [enc.decode(x) for x in ids]} if decoded else {})

        return run

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if decoded:
        fields.append(T.StructField("decoded", T.StringType()))
    return map_texts(df, kernel, fields, keep, text)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the decoded string of each array of identifiers; null for null."""
    from pyspark.sql import functions as F

    @F.udf(T.StringType(), useArrow=True)
    def text_of(x):
        return None if x is None else encoder(path).decode(list(x))

    return df.withColumn(out, text_of(F.col(ids)))
