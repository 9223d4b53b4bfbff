"""Byte-pair vocabularies in the public tokenizers JSON format.

Texts become words (the units that merges never cross) and words become
symbols, one character each, so that both encoders of this package work on
plain strings. The file's path is a parameter; it is read where it is used.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata

import regex

# The two public split patterns.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_END_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Bits of a token identifier in a packed pair.
BITS = 20

MASK = (1 << BITS) - 1

#: Moves a symbol out of the byte alphabet to mark that a word ends with it.
END_MARK = 0x400


def byte_alphabet() -> dict[int, str]:
    """Byte value -> printable character of byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in printable}
    rest = (b for b in range(256) if b not in table)
    return table | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Words, symbols, merges and identifiers of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.specials.items()}
        self._words = regex.compile(WORD_END_SPLIT if self.suffix else BYTE_LEVEL_SPLIT).findall
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        self._bytes = {b: ord(c) for b, c in byte_alphabet().items()}
        self._latin = {b: chr(c) for b, c in self._bytes.items()}
        self.symbols: dict[str, int] = {}  # a symbol -> identifier
        for c in self._latin.values():
            if c in self.ids:
                self.symbols[c] = self.ids[c]
            if self.suffix and c + self.suffix in self.ids:
                self.symbols[chr(ord(c) + END_MARK)] = self.ids[c + self.suffix]
        spelled = {i: s for s, i in self.symbols.items()}
        self.merges: dict[int, int] = {}  # a pair -> rank and merged token, packed by BITS
        self.rank = dict.fromkeys(spelled, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = self.ids[left], self.ids[right], self.ids[left + right]
            self.merges.setdefault(a << BITS | b, rank << BITS | c)
            if c not in spelled and a in spelled and b in spelled:
                spelled[c] = spelled[a] + spelled[b]
                self.rank[c], self.parts[c] = rank, (a, b)
        self.spelled = spelled
        self._base = [self.symbols.get(c) for c in self._latin_order()]
        self._known: set[str] = set()
        self._path, self._library = path, None

    def normalise(self, text: str) -> str:
        """As the word-end vocabulary's normaliser: composed and in lower case."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def words(self, text: str) -> list[str]:
        """Words of text; a special token's string is a word of its own."""
        if "<|" not in text:
            return self._plain_words(text)
        out = []
        for k, part in enumerate(self._special.split(text)):
            if k % 2:
                out.append(part)
            elif part:
                out.extend(self._plain_words(part))
        return out

    def _plain_words(self, text: str) -> list[str]:
        if self.has_new_characters(text):
            return self._library_words(text)
        return self._words(self.normalise(text) if self.suffix else text)

    def spell(self, word: str) -> str:
        """The symbols of a word."""
        s = word.encode("utf-8").decode("latin-1").translate(self._bytes)
        return s[:-1] + chr(ord(s[-1]) + END_MARK) if self.suffix else s

    def merge_down(self, symbols: str) -> tuple[list[int], int]:
        """Identifiers left after all merges, and how many merges there were."""
        node = [self.symbols[c] for c in symbols]
        done = self.merge(node)
        return [t for t in node if t >= 0], done

    def merge(self, node: list[int]) -> int:
        """Merge the symbols in node (those taken away become -1); how many merges.

        The pair of lowest rank (the leftmost of equals) is popped from a heap;
        a linked list over positions joins its halves; entries whose pair is
        gone are passed over. O(n log n) in the length of the word.
        """
        n, find, done = len(node), self.merges.get, 0
        heap = []
        a = node[0]
        for i in range(n - 1):
            b = node[i + 1]
            m = find(a << BITS | b)
            if m is not None:
                heap.append(m << 32 | i)
            a = b
        if not heap:
            return 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            e = pop(heap)
            m, i = e >> 32, e & 0xFFFFFFFF
            j = after[i]
            if j >= n or node[i] < 0 or find(node[i] << BITS | node[j]) != m:
                continue
            done += 1
            c = node[i] = m & MASK
            node[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = find(c << BITS | node[k])
                if m is not None:
                    push(heap, m << 32 | i)
            h = before[i]
            if h >= 0:
                m = find(node[h] << BITS | c)
                if m is not None:
                    push(heap, m << 32 | h)
        return done

    def byte_symbols(self, word: str) -> list[int]:
        """Identifiers of the symbols of a word."""
        if self.suffix:
            return [self.symbols[c] for c in self.spell(word)]
        return [self._base[b] for b in word.encode()]

    def _latin_order(self) -> list[str]:
        return [self._latin[b] for b in range(256)]

    def has_new_characters(self, text: str) -> bool:
        """Whether text has characters that this Python's Unicode tables don't know
        yet: there the tables of different regular-expression engines differ."""
        if text.isascii():
            return False
        if chars := set(text) - self._known:
            if any(unicodedata.category(c) == "Cn" for c in chars):
                return True
            self._known |= chars
        return False

    def _library_words(self, text: str) -> list[str]:
        """Words as the tokenizers library splits them."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        back = {chr(c): b for b, c in self._bytes.items()}
        lib = self._library
        plain = lib.normalizer.normalize_str(text) if lib.normalizer else text
        return [bytes(back[c] for c in w).decode() for w, _ in lib.pre_tokenizer.pre_tokenize_str(plain)]


@functools.lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """A worker process reads a file once."""
    return Vocabulary(path)


class WordCache(dict):
    """word -> result; emptied at its limit, so that memory stays bounded."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.make(word)
        return value
