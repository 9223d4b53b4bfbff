"""Packing of tokenised documents into windows by the sum-of-squares rule.

A document's tokens (its identifiers and an end identifier) first fill whole
windows. What is left goes to the fill level that makes the sum over levels of
the squared count of partly filled windows smallest; a level array holds those
counts. A window that becomes full is given out at once.

Every task packs the rows it reads, in one pass and without a shuffle, so the
work is as even as the input's splits, and a lost task is made again with the
same result. A task keeps at most ``max_open`` windows open, which bounds its
memory (4,096 windows of 2,048 identifiers are 34 MB): beyond that a document is
cut to complete the fullest one, which adds a cut and no padding. At its end the emptiest windows' pieces
are cut to complete the fullest ones, and the one window that is left is cut
into sequences whose lengths are powers of two, which take no padding.

Null text counts as empty: such a document is its end identifier alone.
Repeated rows are packed each by itself. Identifiers of documents may be of any
type; null ones stay null. An empty table gives no pieces.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, vocab
from .common import bounded_batches, give_back_memory, slices, text_or_empty

#: Windows that a task keeps open; bounds its memory.
MAX_OPEN = 4096

Piece = tuple[object, int, np.ndarray, int]  # document, start, identifiers, the document's tokens


class Packer:
    """Online packing of arrays of identifiers; emit(pieces) gets each finished window."""

    def __init__(self, emit, window: int = 2048, max_open: int = MAX_OPEN):
        self.emit, self.window, self.max_open = emit, window, max_open
        self.counts = np.zeros(window + 1, np.int64)  # the level array; 0 and full never count
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0

    def add(self, doc, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        whole = n - n % w
        for at in range(0, whole, w):
            self.emit([(doc, at, ids[at : at + w], n)])
        if whole < n:
            self._place((doc, whole, ids[whole:], n))

    def _place(self, piece: Piece) -> None:
        size, w, counts = len(piece[2]), self.window, self.counts
        levels = np.flatnonzero(counts[: w - size + 1])
        level = 0
        if len(levels):
            after = np.where(levels + size < w, 2 * counts[levels + size] + 1, 0)
            cost = after + 1 - 2 * counts[levels]
            best = len(levels) - 1 - int(np.argmin(cost[::-1]))  # of equals the fullest
            if cost[best] <= 2 * counts[size] + 1:
                level = int(levels[best])
        if not level and self.n_open >= self.max_open:
            doc, start, ids, n = piece
            level = int(np.flatnonzero(counts)[-1])
            room = w - level
            if room < size:
                self._put(level, (doc, start, ids[:room], n))
                self._place((doc, start + room, ids[room:], n))
                return
        self._put(level, piece)

    def _put(self, level: int, piece: Piece) -> None:
        pieces: list[Piece] = []
        if level:
            pieces = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        pieces.append(piece)
        level += len(piece[2])
        if level == self.window:
            self.emit(pieces)
        else:
            self.open.setdefault(level, []).append(pieces)
            self.counts[level] += 1
            self.n_open += 1

    def finish(self) -> None:
        left = [[k, p] for k in sorted(self.open) for p in self.open[k]]  # emptiest first
        self.open, self.n_open = {}, 0
        self.counts[:] = 0
        first = 0
        while first < len(left) - 1:
            fill, pieces = left.pop()
            while fill < self.window and first < len(left):
                source = left[first]
                doc, start, ids, n = source[1].pop()
                take = min(self.window - fill, len(ids))
                rest = len(ids) - take
                pieces.append((doc, start + rest, ids[rest:], n))
                if rest:
                    source[1].append((doc, start, ids[:rest], n))
                fill, source[0] = fill + take, source[0] - take
                if not source[0]:
                    first += 1
            if fill == self.window:
                self.emit(pieces)
            else:
                left.append([fill, pieces])
        for fill, pieces in left[first:]:
            self._powers(fill, pieces)

    def _powers(self, fill: int, pieces: list[Piece]) -> None:
        while fill:
            part = room = 1 << (fill.bit_length() - 1)
            out = []
            while room:
                doc, start, ids, n = pieces.pop(0)
                out.append((doc, start, ids[:room], n))
                if len(ids) > room:
                    pieces.insert(0, (doc, start + room, ids[room:], n))
                room -= len(out[-1][2])
            self.emit(out)
            fill -= part


@functools.lru_cache(maxsize=2)
def _fast_encoder(path: str):
    """The library encoder over the same merges, if ranks and identifiers agree."""
    v = vocab.load(path)
    order = [v.merges[k] & vocab.MASK for k in sorted(v.merges, key=v.merges.get)]
    if v.suffix or order != sorted(order) or len(v.spelled) != len(v.ids):
        return None
    import tiktoken

    back = {c: b for b, c in vocab.byte_alphabet().items()}
    ranks = {bytes(back[c] for c in s): i for s, i in v.ids.items()}
    return tiktoken.Encoding(
        "packing", pat_str=vocab.BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens=v.specials
    )


#: The library's time is quadratic in a word's length; longer ones go to the own encoder.
LONG_RUN = re.compile(r"\S{1000}|\s{1000}")


def token_arrays(path: str, end_id: int):
    """A function from a text to its identifiers and the end identifier.

    Both encoders give what the tokenizers library gives; the own one takes the
    texts on which the fast one is slow or has other Unicode tables."""
    fast, v = _fast_encoder(path), vocab.load(path)

    def encode(text: str) -> np.ndarray:
        if fast is None or v.has_new_characters(text) or LONG_RUN.search(text):
            ids = bpe.encoder(path).encode(text)
        else:
            ids = fast.encode(text, allowed_special="all")
        return np.array([*ids, end_id], dtype="<u4")

    return encode


COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(
    df: DataFrame,
    path: str,
    window: int = 2048,
    end_id: int = 1,
    text: str = "text",
    doc_id: str = "doc_id",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    with_ids adds the piece's identifiers (ids array<int>).
    sequence_id is the task's number times 2^33 plus a running number.
    """
    bounded_batches(df.sparkSession)
    schema = T.StructType([T.StructField("doc_id", df.select(doc_id).schema[0].dataType)])
    for name in COLUMNS:
        schema.add(name, T.LongType())
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        rows: list[tuple] = []
        base, made = TaskContext.get().partitionId() << 33, [0]

        def emit(pieces: list[Piece]) -> None:
            offset = 0
            for doc, start, ids, n in pieces:
                row = (doc, start, len(ids), zlib.crc32(ids.tobytes()), n, base + made[0], offset)
                rows.append((*row, ids.astype(np.int32)) if with_ids else row)
                offset += len(ids)
            made[0] += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * len(out)
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out
            )

        encode, packer = token_arrays(path, end_id), Packer(emit, window)
        for batch in batches:
            for part in slices(batch, "__text"):
                docs = part.column("__doc").to_pylist()
                for doc, value in zip(docs, part.column("__text").to_pylist(), strict=True):
                    packer.add(doc, encode(value))
                yield flush()
        packer.finish()
        yield flush()
        give_back_memory()

    return df.select(F.col(doc_id).alias("__doc"), text_or_empty(text).alias("__text")).mapInArrow(
        run, schema
    )
