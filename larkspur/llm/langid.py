"""Language identification by segmentation-marginalised unigrams.

A language is a probability for every piece of a fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces, which
a forward pass over its characters gives; a text's is the product over its
words (runs of letters, in lower case). Pieces never cross words, so words are
scored once and looked up afterwards. The piece probabilities come from two
rounds of expectation maximisation (forward and backward passes) over the words
of a bounded sample of labelled rows: SAMPLE_DOCS of each language and of those
as many as have SAMPLE_CHARS characters, those with the smallest hashes, of
`languages` languages at most (the most frequent; the model has a column for each).

Null text, and text without a letter (Unicode category L), is `und` with score 0.
Predictions see the text alone, and all of it: words of any length are scored
whole. Without labelled rows everything is `und`. The score is the posterior
probability of the language under equal priors. Repeated rows have equal results;
columns of any name pass through; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, text_udf

#: Bounds of the sample that the model is fitted on: rows and characters of a language, languages.
SAMPLE_DOCS, SAMPLE_CHARS, MAX_LANGUAGES = 300, 1_500_000, 256
ROUNDS = 2
#: Letters up to which words are scored many at a time and remembered, and numbers that a
#: worker keeps of words. Longer words are scored one by one (the sample's are cut in parts).
LONGEST, CACHED_NUMBERS = 50, 1_000_000
#: Probability of a character that no piece covers, and what keeps products in range.
FLOOR, SCALE = 1e-6, 12.0
#: Characters of a long word after which its sums are brought back into range (FLOOR * SCALE
#: to the power of LONGEST, or of RESCALE and a piece's length, is above the smallest double).
RESCALE = 32
#: What marks a word's start in the vocabulary.
START = "▁"


def _numerals() -> str:
    """What Python counts as a word's character but is no letter, decimal digit or _."""
    every = map(chr, range(0x110000))
    return "".join(c for c in every if c.isnumeric() and not c.isalpha() and not c.isdecimal())


#: Runs of letters; the first pattern also takes numerals for letters and is much faster.
RUNS, LETTERS = re.compile(r"[^\W\d_]+"), re.compile(rf"[^\W\d_{_numerals()}]+")


def words(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    text = text.lower()
    found = RUNS.findall(text)
    return found if "".join(found).isalpha() else LETTERS.findall(text)


def in_parts(found: list[str]) -> list[str]:
    if found and max(map(len, found)) > LONGEST:
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


class Pieces:
    """The pieces of a vocabulary file that lower-case words can hold."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = (model.id_to_piece(i) for i in range(model.vocab_size()))
        body = {p for p in every if p == START or LETTERS.fullmatch(p.removeprefix(START)) and p == p.lower()}
        self.names = sorted(body)
        self.matches = ahocorasick.Automaton()
        for i, p in enumerate(self.names):
            self.matches.add_word(p, i << 8 | len(p))
        self.matches.make_automaton()
        self.longest = max(map(len, self.names), default=1)


class Lattice:
    """All pieces in all places of some words, by the place where they end."""

    def __init__(self, pieces: Pieces, batch: list[str]):
        sizes = np.array([len(w) + 1 for w in batch], np.int64)
        places = pieces.matches.iter("".join(START + w for w in batch))
        found = np.fromiter(chain.from_iterable(places), np.int64).reshape(-1, 2)
        first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(batch)), sizes)[found[:, 0]]
        end = found[:, 0] - first[word] + 1
        node = first + np.arange(len(batch))  # a word has one node more than characters
        turn = np.lexsort((word, end))
        self.piece = (found[:, 1] >> 8)[turn]
        self.target = (node[word] + end)[turn]
        self.source = self.target - (found[:, 1] & 255)[turn]
        self.node, self.sizes, self.nodes = node, sizes, int(sizes.sum()) + len(batch)
        self.steps = np.searchsorted(end[turn], np.arange(1, int(sizes.max()) + 2))
        self.by_size = np.argsort(-sizes, kind="stable")
        self.longer = np.searchsorted(-sizes[self.by_size], -np.arange(int(sizes.max()) + 1), side="right")

    def forward(self, probs: np.ndarray) -> np.ndarray:
        """Sums over the segmentations up to each node, for each language (scaled)."""
        total = np.zeros((self.nodes, probs.shape[1]))
        total[self.node] = 1
        for j in range(1, len(self.steps)):
            at = self.node[self.by_size[: self.longer[j]]] + j
            total[at] = total[at - 1] * (FLOOR * SCALE)
            a, b = self.steps[j - 1], self.steps[j]
            if b > a:
                value = total[self.source[a:b]] * probs[self.piece[a:b]]
                cut = np.flatnonzero(np.diff(self.target[a:b], prepend=-1))
                total[self.target[a:b][cut]] += np.add.reduceat(value, cut)
        return total

    def backward(self, probs: np.ndarray) -> np.ndarray:
        total = np.zeros((self.nodes, probs.shape[1]))
        total[self.node + self.sizes] = 1
        for j in range(len(self.steps) - 1, 0, -1):
            a, b = self.steps[j - 1], self.steps[j]
            at = self.node[self.by_size[: self.longer[j]]] + j
            total[at - 1] += total[at] * (FLOOR * SCALE)
            np.add.at(total, self.source[a:b], total[self.target[a:b]] * probs[self.piece[a:b]])
        return total

    def scores(self, probs: np.ndarray) -> np.ndarray:
        """Log probability of each word for each language."""
        whole = self.forward(probs)[self.node + self.sizes]
        return np.log(whole) - (self.sizes * np.log(SCALE))[:, None]


def long_scores(pieces: Pieces, word: str, probs: np.ndarray) -> np.ndarray:
    """As Lattice.scores of one word of any length, in memory that doesn't grow with
    it: of the forward sums only those are kept that a piece can still reach, and
    they are brought back into range as they leave it."""
    keep, n = pieces.longest, len(word) + 1
    total = np.zeros((keep + RESCALE, probs.shape[1]))
    total[keep - 1] = 1
    logs, at = np.zeros(probs.shape[1]), keep
    found = pieces.matches.iter(START + word)
    end, packed = next(found, (n, 0))
    for j in range(n):
        value = total[at - 1] * (FLOOR * SCALE)
        while end == j:
            value = value + total[at - (packed & 255)] * probs[packed >> 8]
            end, packed = next(found, (n, 0))
        total[at] = value
        at += 1
        if at == len(total):
            high = value.copy()
            total[:keep] = total[-keep:] / high
            logs += np.log(high)
            at = keep
    return logs + np.log(total[at - 1]) - n * np.log(SCALE)


def scaled(pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    return probs * SCALE ** np.array([len(p) for p in pieces.names])[:, None]


def fit(pieces: Pieces, counts: list[Counter], rounds: int = ROUNDS, part: int = 5_000) -> np.ndarray:
    """Piece probabilities (pieces x languages) from each language's word counts."""
    n, langs = len(pieces.names), len(counts)
    probs = np.full((n, langs), 1.0 / n)
    every = sorted(set().union(*counts))
    times = np.array([[c[w] for c in counts] for w in every], float).reshape(-1, langs)
    for _ in range(rounds):
        use, expected = scaled(pieces, probs), np.full((n, langs), 0.01)
        for k in range(0, len(every), part):
            lattice, weight = Lattice(pieces, every[k : k + part]), times[k : k + part]
            ahead, behind = lattice.forward(use), lattice.backward(use)
            share = weight / ahead[lattice.node + lattice.sizes]
            of = np.repeat(np.arange(len(lattice.node)), lattice.sizes + 1)[lattice.source]
            value = ahead[lattice.source] * use[lattice.piece] * behind[lattice.target] * share[of]
            np.add.at(expected, lattice.piece, value)
        probs = expected / expected.sum(0)
    return probs


def in_held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _share(count: int, docs: int) -> int:
    """Of a million hash values, so many that `docs` of count rows almost surely have one:
    rounded up, so that no language is without a sample however many rows it has."""
    return math.ceil(min(1.0, 1.5 * (docs + 30) / count) * 1_000_000)


def sample(
    df: DataFrame, label: str, doc_id: str, text: str, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, languages: int = MAX_LANGUAGES
) -> dict[str, list[str]]:
    """Texts of up to `docs` rows of each language that aren't held out: of these
    the first, and more as long as all before them have no more than `chars` characters."""
    known = df.where(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    known = known.where(~in_held_out(doc_id)).select(
        F.col(label).cast("string").alias("lang"), F.col(doc_id).alias("id"), F.col(text).alias("text")
    )
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not sizes:
        return {}
    # A share of each language that holds `docs` rows almost surely, then the first of them.
    share = F.lit(0)
    for row in sizes:
        share = F.when(F.col("lang") == row["lang"], _share(row["count"], docs)).otherwise(share)
    mixed = F.xxhash64("id", F.lit("language sample"))
    few = known.withColumn("h", mixed).where(F.pmod("h", F.lit(1_000_000)) < share)
    first = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1_000_000)), "id")
    few = few.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= docs)
    few = few.withColumn("chars", F.sum(F.length("text").cast("long")).over(first.rowsBetween(Window.unboundedPreceding, -1)))
    out: dict[str, list[str]] = {}
    for row in few.where(F.coalesce("chars", F.lit(0)) <= chars).select("lang", "text").collect():
        out.setdefault(row["lang"], []).append(row["text"])
    return dict(sorted(out.items()))


class Scorer:
    def __init__(self, pieces: Pieces, langs: list[str], probs: np.ndarray):
        self.pieces, self.langs, self.probs = pieces, langs, scaled(pieces, probs)
        self.limit = max(1, CACHED_NUMBERS // max(1, len(langs)))
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, len(langs)), np.float32)

    def _learn(self, new: list[str]) -> None:
        base = len(self.place)
        self.place.update(zip(new, range(base, base + len(new)), strict=True))
        parts = [Lattice(self.pieces, new[k : k + 5_000]).scores(self.probs) for k in range(0, len(new), 5_000)]
        need = base + len(new)
        if need > len(self.rows):
            more = np.zeros((max(need, 2 * len(self.rows)), len(self.langs)), np.float32)
            more[:base] = self.rows[:base]
            self.rows = more
        self.rows[base:need] = np.concatenate(parts)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        split = [words(t) for t in texts]
        pred, score = ["und"] * len(texts), [0.0] * len(texts)
        if not any(split) or not self.langs:
            return pred, score
        logs = np.zeros((len(texts), len(self.langs)))
        some = [i for i, s in enumerate(split) if s]
        for i in some:
            if max(map(len, split[i])) > LONGEST:
                for w in split[i]:
                    if len(w) > LONGEST:
                        logs[i] += long_scores(self.pieces, w, self.probs)
                split[i] = [w for w in split[i] if len(w) <= LONGEST]
        flat = [w for s in split for w in s]
        if flat:
            different = set(flat)  # of one slice of a batch, so bounded
            new = different.difference(self.place)
            if len(self.place) + len(new) > self.limit:
                self.place, self.rows, new = {}, self.rows[:0], different
            if new:
                self._learn(sorted(new))
            at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
            sizes = np.array([len(s) for s in split])
            short = np.flatnonzero(sizes)
            first = (np.cumsum(sizes) - sizes)[short]
            logs[short] += np.add.reduceat(self.rows[at].astype(np.float64), first)
        best = logs.argmax(1).tolist()
        sure = (1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)).tolist()
        for i in some:
            pred[i], score[i] = self.langs[best[i]], sure[i]
        return pred, score


def predictor(
    df: DataFrame, path: str, label: str = "lang", doc_id: str = "doc_id", text: str = "text", languages: int = MAX_LANGUAGES
) -> Callable[[Column], Column]:
    """A function from a column of texts to struct<lang_pred string, score double>;
    the model is fitted on df's labels."""
    texts = sample(df, label, doc_id, text, languages=languages)
    langs = list(texts)
    counts = [Counter(w for t in texts[lang] for w in in_parts(words(t))) for lang in langs]
    probs = fit(Pieces(path), counts).astype(np.float32) if langs else np.zeros((0, 0), np.float32)
    model = df.sparkSession.sparkContext.broadcast((langs, probs))  # pieces x languages, both bounded

    def kernel():
        known, table = model.value
        scorer = Scorer(Pieces(path), known, table) if known else None

        def run(batch: list[str]) -> pa.Array:
            pred, score = scorer.predict(batch) if scorer else (["und"] * len(batch), [0.0] * len(batch))
            return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

        return run

    return text_udf(kernel, "struct<lang_pred: string, score: double>")


def identify(
    df: DataFrame, path: str, keep: list[str], label: str = "lang", doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """keep's columns, lang_pred and score; the model is fitted on df's own labels."""
    judged = fresh("__judged", df)
    rows = df.select(*keep, predictor(df, path, label, doc_id, text)(F.col(text)).alias(judged))
    return rows.select(*keep, f"{judged}.lang_pred", f"{judged}.score")
