"""Homomorphic document fingerprints, in DataFrame functions only.

A text is the multiset of its paragraphs: its lines, and within a line what
ends with ". ", "! " or "? ". A paragraph's SHA-256 digest gives its vector: eight
wide lanes, the digest's 32-bit numbers, and 64 narrow ones, its hexadecimal digits.
A fingerprint is the number of paragraphs and the lanes' sums modulo 2^32. The order
of paragraphs doesn't matter; equal multisets have equal fingerprints; a paragraph is
inserted or deleted by adding or subtracting its vector. The wide lanes, whose sums
wrap around, tell different multisets apart. The narrow ones, as differences from the
mean, are a random projection, so their cosine estimates how many paragraphs two
texts share.

Null text counts as empty (one empty paragraph). Sums are exact up to eight
million paragraphs in a text. Repeated rows have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES, CHUNKS = 64, 8
#: Digits of a number in the order of their lanes (0 is the lowest).
PLACES = (0, 4, 1, 5, 2, 6, 3, 7)
#: Rows that a task of `with_next` holds in order, about; buckets at most.
BUCKET_ROWS, MAX_BUCKETS = 500, 65_536


def paragraphs(text: Column) -> Column:
    for mark in ".!?":
        text = F.replace(text, F.lit(f"{mark} "), F.lit(f"{mark}\n "))
    return F.split(text, "\n", -1)


def _numbers(paragraph: Column) -> Column:
    """The paragraph's digest as 8 numbers of 32 bits."""
    digest = F.sha2(paragraph, 256)
    return F.transform(
        F.lit([8 * k + 1 for k in range(CHUNKS)]),
        lambda at: F.conv(F.substring(digest, at, F.lit(8)), 16, 10).cast("long"),
    )


def with_vector(df: DataFrame, text: Column, out: str) -> DataFrame:
    """df with array<long> out: the number of paragraphs, then the sums of the 8 wide and
    of the 64 narrow lanes."""
    low = F.lit(0xFFFFFFFF)

    def pair(k: int, first: int) -> Column:
        """Sums of digits first and first + 4 of number k, one in each half of a long."""

        def add(total: Column, x: Column) -> Column:
            n = F.element_at(x, k + 1)
            n = F.shiftright(n, 4 * first) if first else n
            return total + n.bitwiseAND(F.lit(0xF)) + F.shiftleft(n.bitwiseAND(F.lit(0xF0000)), 16)

        return F.aggregate("__numbers", F.lit(0).cast("long"), add)

    sums = F.array(*[pair(k, first) for k in range(CHUNKS) for first in range(4)])
    lanes = F.flatten(
        F.transform(sums, lambda s: F.array(s.bitwiseAND(low), F.shiftrightunsigned(s, 32).bitwiseAND(low)))
    )

    def wide_lane(k: int) -> Column:
        total = F.aggregate("__numbers", F.lit(0).cast("long"), lambda total, x: total + F.element_at(x, k + 1))
        return total.bitwiseAND(low)

    wide = [wide_lane(k) for k in range(CHUNKS)]
    total = F.concat(F.array(F.size("__numbers").cast("long"), *wide), lanes)
    numbers = F.transform(paragraphs(text), _numbers)
    return df.withColumn("__numbers", numbers).withColumn(out, total).drop("__numbers")


def as_string(v: Column) -> Column:
    """Eight hexadecimal digits for the count and for each lane."""
    return F.array_join(F.transform(v, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two fingerprints about their means, 0 at least; 1 for equal ones."""

    def centred(v: Column) -> Column:
        n = F.element_at(v, 1)
        return F.transform(F.slice(v, 2 + CHUNKS, LANES), lambda x: (2 * x - 15 * n).cast("double"))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    x, y = centred(a), centred(b)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    cosine = F.round(F.when(norm > 0, dot(x, y) / norm).otherwise(0.0), 6)
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def insert(v: Column, paragraph: Column, times: int = 1) -> Column:
    """The fingerprint vector v with a paragraph added (times -1: taken away)."""
    numbers = _numbers(paragraph)
    own = F.flatten(
        F.transform(numbers, lambda n: F.array(*[F.shiftright(n, 4 * b).bitwiseAND(F.lit(0xF)) for b in PLACES]))
    )
    return F.zip_with(
        v, F.concat(F.array(F.lit(1).cast("long")), numbers, own), lambda s, x: F.pmod(s + times * x, F.lit(1 << 32))
    )


def with_next(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """df and, from the next row in descending key order (after the last: the
    first), columns under new names. Null keys count as the smallest; rows of
    one key stand in an order that their values fix.

    Rows go to buckets of neighbouring keys, whose borders are quantiles of the
    key; a border's rows also go, as guests, to the bucket that needs them.
    """
    least = F.lit(-(1 << 63)).cast("long")
    keyed = df.withColumn("__key", F.coalesce(F.col(key).cast("long"), least))
    rows = keyed.select("__key").agg(F.count(F.lit(1)), F.max("__key")).first()
    buckets = min(MAX_BUCKETS, -(-rows[0] // BUCKET_ROWS)) or 1
    shares = [i / buckets for i in range(1, buckets)]
    inner = (
        keyed.agg(F.percentile_approx("__key", F.lit(shares), F.lit(max(10_000, 4 * buckets)))).first()[0]
        if shares and rows[0]
        else []
    )
    bounds = sorted({*inner, rows[1]}) if rows[0] else [0]
    n, held = len(bounds), F.lit(bounds)
    steps = F.lit([1 << i for i in range(n.bit_length())][::-1])
    bucket = F.aggregate(  # how many bounds are below the key, by halving
        steps,
        F.lit(0),
        lambda at, step: F.when(
            (at + step < n) & (F.element_at(held, F.least(at + step, F.lit(n))) < F.col("__key")), at + step
        ).otherwise(at),
    )
    is_bound = F.element_at(held, F.col("__bucket") + 1) == F.col("__key")
    places = F.when(
        is_bound,
        F.array(
            F.struct(F.col("__bucket").alias("b"), F.lit(0).alias("guest")),
            F.struct(((F.col("__bucket") + 1) % n).alias("b"), F.lit(1).alias("guest")),
        ),
    ).otherwise(F.array(F.struct(F.col("__bucket").alias("b"), F.lit(0).alias("guest"))))
    spread = keyed.withColumn("__bucket", bucket).withColumn("__at", F.explode(places)).drop("__bucket")
    spread = spread.select("*", F.col("__at.b").alias("__b"), F.col("__at.guest").alias("__guest")).drop("__at")
    tie = F.xxhash64(*columns)
    w = Window.partitionBy("__b").orderBy("__guest", F.col("__key").desc(), tie)
    spread = spread.select("*", *[F.lead(old).over(w).alias(new) for old, new in columns.items()])
    return spread.where("__guest = 0").drop("__key", "__b", "__guest")


def edit_report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has its last floor(n/2) characters replaced by the first as
    many (or all) of the next document, in descending doc_id.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = with_vector(docs, F.col("text"), "own")
    docs = with_next(docs, "doc_id", {"text": "next_text", "own": "next"})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), "own", "next", edited.alias("edited"))
    docs = with_vector(docs, F.col("edited"), "changed")
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("own")).alias("fingerprint"),
        as_string(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


_NUMBERS = """list_transform(
  string_split(replace(replace(replace({0}, '. ', '.' || chr(10) || ' '), '! ', '!' || chr(10) || ' '), '? ', '?' || chr(10) || ' '), chr(10)),
  lambda p: sha256(p))"""
_LANES = """list_concat([len({0})::BIGINT], list_transform(range(8), lambda k: (list_sum(list_transform({0},
  lambda h: ('0x' || substr(h, (k * 8 + 1)::BIGINT, 8))::BIGINT)) % 4294967296)::BIGINT), list_transform(range(64), lambda i: list_sum(list_transform({0},
  lambda h: ((('0x' || substr(h, ((i // 8) * 8 + 1)::BIGINT, 8))::BIGINT >> (4 * [0, 4, 1, 5, 2, 6, 3, 7][(i % 8) + 1])) & 15)))::BIGINT))"""
_STRING = "list_aggregate(list_transform({0}, lambda x: printf('%08x', x)), 'string_agg', '')"
_CENTRED = "list_transform({0}[10:], lambda x: (2 * x - 15 * {0}[1])::DOUBLE)"
_LIKE = """CASE WHEN {0} = {1} THEN 1.0::DOUBLE ELSE greatest(0.0, least(1.0, round(coalesce(
  list_inner_product({0}_c, {1}_c) / nullif(sqrt(list_inner_product({0}_c, {0}_c)) * sqrt(list_inner_product({1}_c, {1}_c)), 0), 0.0), 6))) END"""

EDIT_REPORT_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ordered AS (
  SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
  FROM docs WINDOW w AS (ORDER BY doc_id DESC)),
edits AS (
  SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited
  FROM ordered),
numbers AS (
  SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, {_NUMBERS.format("text")} AS a,
    {_NUMBERS.format("next_text")} AS b, {_NUMBERS.format("edited")} AS c FROM edits),
lanes AS (SELECT *, {_LANES.format("a")} AS own, {_LANES.format("b")} AS nxt, {_LANES.format("c")} AS changed FROM numbers),
centred AS (SELECT *, {_CENTRED.format("own")} AS own_c, {_CENTRED.format("nxt")} AS nxt_c, {_CENTRED.format("changed")} AS changed_c FROM lanes)
SELECT doc_id, n_chars::BIGINT AS n_chars, edited_sha256, {_STRING.format("own")} AS fingerprint,
  {_STRING.format("changed")} AS edited_fingerprint,
  {_LIKE.format("own", "changed")} AS near_edited, {_LIKE.format("own", "nxt")} AS near_next
FROM centred"""
