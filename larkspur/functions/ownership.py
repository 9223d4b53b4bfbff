"""Which instance owns a correlation's group: a hash that all peers share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shared hash's start, multiplier and two mixing factors.
START, TIMES, MIX1, MIX2 = 5381, 33, 0x85EBCA6B, 0xC2B2AE35
_LOW = 0xFFFFFFFF


def owner_key(corr_id: Column, *group: Column) -> Column:
    """The identifier and the group's values, joined by tabs; null counts as empty."""
    empty = F.lit("")
    return F.concat_ws("\t", F.coalesce(corr_id, empty), *[F.coalesce(g, empty) for g in group])


def _times32(h: Column, factor: int) -> Column:
    """h * factor modulo 2^32, by halves, which stay below 2^63."""
    low, high = factor & 0xFFFF, factor >> 16
    return (h * low + F.shiftleft((h * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_LOW))


def owner_hash(key: Column) -> Column:
    byte = F.sequence(F.lit(1), F.octet_length(key))
    value = F.hex(key.cast("binary"))
    bytes_of = F.when(
        F.octet_length(key) > 0,
        F.transform(byte, lambda i: F.conv(F.substring(value, 2 * i - 1, F.lit(2)), 16, 10).cast("long")),
    ).otherwise(F.array().cast("array<bigint>"))
    h = F.aggregate(
        bytes_of, F.lit(START).cast("bigint"), lambda h, b: (h * TIMES + b).bitwiseAND(F.lit(_LOW))
    )
    # The finaliser, a step at a time; each step is a one-element fold so that it is computed once.
    steps = [
        lambda x: x.bitwiseXOR(F.shiftright(x, 16)),
        lambda x: _times32(x, MIX1),
        lambda x: x.bitwiseXOR(F.shiftright(x, 13)),
        lambda x: _times32(x, MIX2),
        lambda x: x.bitwiseXOR(F.shiftright(x, 16)),
    ]
    mixed = F.array(h)
    for step in steps:
        mixed = F.transform(mixed, step)
    return F.get(mixed, F.lit(0))


def owner_index(peers: int, corr_id: Column, *group: Column) -> Column:
    """The owner among so many peers (0 if there are none)."""
    if peers <= 0:
        return F.lit(0).cast("long")
    return owner_hash(owner_key(corr_id, *group)) % peers


def python_owner_index(peers: int, corr_id: str, group) -> int:
    h = START
    for b in "\t".join([corr_id or "", *[g or "" for g in group]]).encode():
        h = (h * TIMES + b) & _LOW
    h ^= h >> 16
    h = h * MIX1 & _LOW
    h ^= h >> 13
    h = h * MIX2 & _LOW
    h ^= h >> 16
    return h % peers if peers else 0
