"""Substring deduplication by content-defined chunks.

A gear hash rolls over a text's bytes; where its bits from the 16th on are a
multiple of RARITY and a word ends, a chunk ends. Borders depend on the bytes
just before them alone, so an insertion moves no border beyond itself, and a
passage is cut alike wherever it stands, but for its edges. After 64 bytes
without a border every word is a chunk (as in one word said again and again).
Han and Kana, and runs of more than 24 bytes without white space, are also cut
at characters, so often that a chunk has about DENSE bytes there, too.

What is compared, by a 128-bit digest over all documents, are JOINED neighbouring
chunks, as single short ones repeat by chance. The digests are shuffled once; those
that stand in very many documents (found in a share of them) are not, as their few
first places are broadcast. The place in the smallest doc_id
(within a document: the first) is kept; a run of chunks that repeat an earlier
place is a repeated span if it has min_chars or more. A passage's edges, as far
as its first and behind its last border, are not counted: of passages that have
few more than min_chars many are not found (the README has figures).

Null and empty texts have no chunks. Equal rows count as one document, different
texts of one doc_id as several (the one with the smallest hash is the first);
null doc_ids count as the smallest one. Identifiers of any type that has an order
will do. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .common import cut_lineage, map_texts, remove_written, spliced, written

GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
#: One word's end in so many is a border; chunks that are compared together.
RARITY, JOINED = 5, 2
#: A border needs the rolled window whole; so no chunk at a text's start is shorter.
WINDOW = 32
#: Bytes without a border after which every word ends a chunk, and a chunk's longest.
NO_BORDER, LONGEST = 64, 1024
#: Bytes without white space after which characters are borders, one in DENSE bytes (a power of 2).
NO_SPACE, DENSE = 24, 32
#: Spans (some 50 bytes each) whose lists are broadcast rather than shuffled.
FEW_SPANS = 500_000
#: Characters of a run of repeated chunks that count as a repeated span.
MIN_CHARS = 100
#: A chunk whose digest stands in about so many documents, or in one of so many chunks
#: if that is more, isn't gathered by its digest.
HOT, HOT_SHARE = 1_000, 100_000
#: Places of such a chunk in the sample that finds them, about twice.
SAMPLED = 10
_OF_BYTE = np.random.default_rng(11).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def rolled(raw: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash (h = 2 h + gear[byte]) up to every byte."""
    h = GEAR[raw]
    for s in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[s:] += h[:-s] << np.uint32(s)
        h = longer
    return h


def ends_of_chunks(raw: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Ascending ends of all chunks; every text's end is one."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    h = rolled(raw)
    space = shingles._SPACE[raw]
    place = np.arange(n)
    begin = np.repeat(borders[:-1], np.diff(borders))
    since = place - np.maximum(np.maximum.accumulate(np.where(space, place, 0)), begin)
    whole = np.append(raw[1:] & 0xC0 != 0x80, True)  # the next byte starts a character
    cut = space & ((h >> np.uint32(16)) % np.uint32(RARITY) == 0)
    # The five bits below the 16th are of 16 bytes; wider characters are cut as much oftener.
    lead = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, place, 0))
    unspaced = (since > NO_SPACE) | (raw[lead] >= 0xE3) & (raw[lead] <= 0xE9)  # U+3000 to U+9FFF
    cut |= unspaced & whole & ((h >> np.uint32(11)) & np.uint32(DENSE - 1) < place - lead + 1)
    cut &= place - begin >= WINDOW  # before that the hash is also of the previous text
    # Where nothing has cut for long (as in a word said again and again), words do.
    last = np.maximum.accumulate(np.where(cut, place, begin))
    cut |= space & (place - np.append(0, last[:-1]) > NO_BORDER)
    cut &= place - begin >= WINDOW
    ends = np.union1d(np.flatnonzero(cut) + 1, borders[1:])
    ends = ends[ends > 0]
    size = np.diff(ends, prepend=0)
    if size.max() > LONGEST:  # cut what is left over, at characters
        more = []
        for k in np.flatnonzero(size > LONGEST):
            at, end = int(ends[k] - size[k]) + LONGEST, int(ends[k])
            while at < end:
                while at < end and raw[at] & 0xC0 == 0x80:
                    at += 1
                more.append(at)
                at += LONGEST
        ends = np.union1d(ends, np.array(more, ends.dtype))
    return ends


def cut_texts(texts: pa.Array) -> tuple[list[pa.Array], list[np.ndarray], list[np.ndarray]]:
    """For each text the two halves of the digests of its joined chunks (the first is
    null where the text has had the same before), and its chunks' sizes in characters."""
    raw, borders = shingles.buffer(texts)
    ends = ends_of_chunks(raw, borders)
    if not len(ends):
        none = [np.zeros(0, np.int64)] * len(texts)
        return [pa.array([], pa.int64())] * len(texts), none, none
    starts = np.append(0, ends[:-1])
    size = ends - starts
    power = np.cumprod(np.full(int(size.max()), shingles._STEP | np.uint64(1)))
    power = power[np.arange(len(raw)) - np.repeat(starts, size)]
    at = np.searchsorted(ends, borders, side="right")
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    halves = []
    for of_byte in _OF_BYTE:
        digest = shingles.mix(np.add.reduceat(of_byte[raw] * power, starts) + size.astype(np.uint64))
        joined = np.zeros(len(digest), np.uint64)
        for k in range(JOINED):  # of the same text only: a text of one chunk has its own digest alone
            n = max(0, len(digest) - k)
            joined[:n] += np.where(text[:n] == text[k:], digest[k:] * shingles._PLACE[k], np.uint64(0))
        halves.append(shingles.mix(joined).view(np.int64))
    chars = np.append(0, np.cumsum(raw & 0xC0 != 0x80))
    sizes = chars[ends] - chars[starts]
    high, low = [], []
    for a, b in zip(at[:-1], at[1:], strict=True):
        own = slice(a, max(min(a + 1, b), b - JOINED + 1))
        again = np.ones(len(halves[0][own]), bool)
        again[np.unique(halves[0][own], return_index=True)[1]] = False
        high.append(pa.array(halves[0][own], mask=again))
        low.append(halves[1][own])
    return high, low, [sizes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def chunk_table(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, hash (of the text), high, low (halves of the digests), sizes of every document."""

    def lists(parts: list, kind: pa.DataType) -> pa.ListArray:
        flat = pa.concat_arrays([pa.array(p, kind) for p in parts]) if parts else pa.array([], kind)
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), flat)

    def kernel():
        def run(texts):
            high, low, sizes = cut_texts(pa.array(texts, pa.string()))
            return {"high": lists(high, pa.int64()), "low": lists(low, pa.int64()), "sizes": lists(sizes, pa.int32())}

        return run

    fields = [
        T.StructField("high", T.ArrayType(T.LongType())),
        T.StructField("low", T.ArrayType(T.LongType())),
        T.StructField("sizes", T.ArrayType(T.IntegerType())),
    ]
    named = df.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    return map_texts(named, kernel, fields, ["doc", "hash"])


def repeated_spans(
    df: DataFrame, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """A row for each repeated span: doc_id, span_start, span_end (characters,
    end exclusive), n_chunks, first_doc_id, the document in which its beginning
    stands first (its own if it has stood there before), and text_hash, which tells apart the texts of one doc_id. The chunks
    are written to the shared folder and deleted when the spans are there."""
    spark = df.sparkSession
    table, path = written(chunk_table(df, doc_id, text), "chunks")
    table, more = _texts_once(table)
    # The digests' shuffle is deleted before those behind it are written.
    later, again = written(_later(table, _often(table)), "repeats")
    spans = cut_lineage(_spans(table, later, min_chars))
    for p in (path, again, *more):
        remove_written(spark, p)
    return spans


def _texts_once(table: DataFrame) -> tuple[DataFrame, list[str]]:
    """The chunk table with each text of a doc_id once, and part: the text's hash where
    its doc_id has several, else 0. Only rows of doc_ids that occur again are shuffled."""
    again = table.groupBy("doc").agg(
        F.count(F.lit(1)).alias("rows"), (F.min("hash") != F.max("hash")).alias("several")
    )
    again = cut_lineage(again.where("rows > 1").select(F.col("doc").alias("of"), "several"))
    alone = F.lit(0).cast("long")
    n = again.count()
    if not n:
        return table.withColumn("part", alone), []
    again = F.broadcast(again) if n <= FEW_SPANS else again
    same = table["doc"].eqNullSafe(again["of"])
    rest = table.join(again, same).drop("of").dropDuplicates(["doc", "hash"])
    rest = rest.withColumn("part", F.when(F.col("several"), F.col("hash")).otherwise(alone)).drop("several")
    rest, path = written(rest, "chunks-again")
    return table.join(again, same, "left_anti").withColumn("part", alone).unionByName(rest), [path]


def _places(table: DataFrame) -> DataFrame:
    """doc, part, i, high, low of every digest."""
    digests = F.posexplode(F.arrays_zip("high", "low")).alias("i", "d")
    return table.select("doc", "part", digests).select("doc", "part", "i", "d.high", "d.low")


def _often(table: DataFrame) -> DataFrame:
    """high, low of the digests that stand in many documents: those with SAMPLED places
    or more in a share of the documents that has twice as many of a chunk that is HOT.
    What the share misses is shuffled by its digest instead, with the same result."""
    total = table.agg(F.coalesce(F.sum(F.size("high")), F.lit(0))).first()[0]
    share = max(1, max(HOT, total // HOT_SHARE) // (2 * SAMPLED))
    some = _places(table.where(F.pmod(F.xxhash64("doc", "part", F.lit("share")), F.lit(share)) == 0))
    many = some.where("high is not null").groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(many.where(F.col("n") >= SAMPLED).select("high", "low"))


def _later(table: DataFrame, often: DataFrame) -> DataFrame:
    """doc, part, i, source of every digest that stands earlier, too."""
    keys, digest = ["doc", "part"], ["high", "low"]
    rows = _places(table)
    own = rows.where("high is null").select(*keys, "i", F.col("doc").alias("source"))
    rows = rows.where("high is not null").withColumn("place", F.struct(*keys))
    # Both tables are bounded by the sample's size (2 x HOT_SHARE rows or so). Rows of a
    # frequent digest know its first place before they are shuffled, and are spread.
    zero = F.lit(0).cast("long")
    often = F.broadcast(often.select(F.col("high").alias("a"), F.col("low").alias("b")))
    held = rows.join(often, (F.col("high") == F.col("a")) & (F.col("low") == F.col("b")), "left")
    first = held.groupBy(F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b")).agg(
        F.min(F.when(F.col("a").isNotNull(), F.col("place"))).alias("known")  # combined before it is shuffled
    )
    rows = rows.join(F.broadcast(first), (F.col("high") == F.col("a")) & (F.col("low") == F.col("b")), "left")
    rows = rows.withColumn("salt", F.when(F.col("known").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(*keys, "i")))
    own_first = F.min("place").over(Window.partitionBy(*digest, "salt"))
    rows = rows.withColumn("first", F.coalesce("known", own_first))
    later = rows.where("place != first").select(*keys, "i", F.col("first.doc").alias("source"))
    return later.union(own)


def _spans(table: DataFrame, later: DataFrame, min_chars: int) -> DataFrame:
    keys = ["doc", "part"]
    in_order = Window.partitionBy(*keys).orderBy("i")
    apart = F.col("i") - F.lag("i", 1, -JOINED - 2).over(in_order) > JOINED
    runs = later.withColumn("new", apart.cast("int")).withColumn("run", F.sum("new").over(in_order))
    runs = runs.groupBy(*keys, "run").agg(
        F.min("i").alias("a"), F.max("i").alias("b"), F.min_by(F.struct("source"), "i").alias("source")
    )
    runs = runs.groupBy(*keys).agg(F.collect_list(F.struct("a", "b", "source.source")).alias("runs"))
    runs = runs.select(F.col("doc").alias("of"), F.col("part").alias("of_part"), "runs")
    sizes = table.select(*keys, "hash", "sizes")
    total = lambda n: F.aggregate(F.slice("sizes", F.lit(1), n), F.lit(0).cast("long"), lambda s, x: s + x)
    last = F.least(F.col("r.b") + JOINED, F.size("sizes"))
    return (
        runs.join(sizes, F.col("of").eqNullSafe(sizes["doc"]) & (F.col("of_part") == sizes["part"]))
        .select("doc", "hash", "sizes", F.explode("runs").alias("r"))
        .select(
            F.col("doc").alias("doc_id"),
            total(F.col("r.a")).alias("span_start"),
            total(last).alias("span_end"),
            (last - F.col("r.a")).cast("long").alias("n_chunks"),
            F.col("r.source").alias("first_doc_id"),
            F.col("hash").alias("text_hash"),
        )
        .where(F.col("span_end") - F.col("span_start") >= min_chars)
    )


def remove_spans(
    df: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text", few: int = FEW_SPANS
) -> DataFrame:
    """df with each text freed of its spans (of its doc_id and hash); other rows as they are."""
    lists = spans.groupBy(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("span_start").alias("start"), F.col("span_end").alias("end")))).alias("__cuts")
    )
    if spans.count() <= few:  # else texts and lists are shuffled to each other
        lists = F.broadcast(lists)
    rows = df.select(F.struct("*").alias("__row"), F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    same = F.col("__id").eqNullSafe(F.col("__doc")) & (F.xxhash64("__text") == F.col("__hash"))
    rows = rows.join(lists, same, "left").withColumn("__text", spliced(F.col("__text"), F.col("__cuts"), F.lit("")))
    return rows.select(*[F.col("__text").alias(c) if c == text else F.col("__row").getField(c).alias(c) for c in df.columns])
