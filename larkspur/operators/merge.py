"""Partial aggregates of one instance, and their merging into another's groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import to_f64
from ..plans.model import Correlation
from ..sources.contrib import kind_for
from ..sources.events import Resolver
from ..streaming.kernel import Caps
from .correlate import described, fold, watched


def partials(df: DataFrame, c: Correlation, field: Resolver) -> DataFrame:
    """The contributions that a batch's events make: kind, corr_id, ts (the last
    event's), group and what the kind carries. Counted in each task before anything
    is shuffled; a distinct value is a row of its own."""
    kind = kind_for(c)
    if kind is None:
        raise ValueError(f"{c.type} is evaluated where its events are")
    rows = watched(df, c, field)
    count, numeric = F.lit(None).cast("long"), F.lit(None).cast("double")
    value, mask = F.lit(None).cast("string"), F.lit(None).cast("long")
    keys = ["grp"]
    if kind == "distinct":
        rows, keys = rows.where(F.col("value").isNotNull()), ["grp", "value"]
        value = F.col("value")
    if kind == "sum":
        rows = rows.withColumn("number", to_f64(F.col("value"))).where(F.col("number").isNotNull())
    bits = [
        F.when(F.array_contains("rids", F.lit(r).cast("long")), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0))
        for i, r in enumerate(c.base_rule_ids[:64])
    ]
    seen = reduce(lambda a, b: a.bitwiseOR(b), [b.cast("long") for b in bits])
    extra = [F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"), F.bit_or(seen).alias("mask")]
    if kind == "sum":
        extra.append(F.sum("number").alias("total"))
    out = rows.groupBy(*keys).agg(*extra)
    if kind in ("count", "sum"):
        count = F.col("n")
    if kind == "sum":
        numeric = F.col("total")
    if kind == "seen":
        mask = F.col("mask")
    return out.select(
        F.lit(kind).alias("kind"), F.lit(c.id).alias("corr_id"), "ts", F.col("grp").alias("group"),
        count.alias("count"), numeric.alias("numeric"), value.alias("value"), mask.alias("seen_mask"),
    )


def merge(
    events: DataFrame, contributions: DataFrame, c: Correlation, field: Resolver, caps: Caps = Caps()
) -> DataFrame:
    """Fires of events and contributions in one arrival order: both have `ord`, of
    one type; contributions as `contrib.decode` gives them. Accumulated parts are
    not aged by the window, and a group that had one is marked remote."""
    nothing = {"kind": "string", "count": "long", "numeric": "double", "seen_mask": "long"}
    own = watched(events, c, field).select("*", *[F.lit(None).cast(t).alias(n) for n, t in nothing.items()])
    theirs = contributions.where(F.col("corr_id") == c.id).where(F.size("group") == len(c.group_by))
    theirs = theirs.where(~F.exists("group", lambda g: g.isNull())).select(
        "ord", F.col("ts").cast("double").alias("ts"), F.lit(None).cast("array<long>").alias("rids"),
        F.col("group").alias("grp"), "value", *nothing,
    )
    return described(fold(own.unionByName(theirs).withColumn("c", F.lit(0)), [c], caps), [c])


def total(contributions: DataFrame) -> DataFrame:
    """Contributions of each group added up, as an owner's accumulators hold them."""
    return contributions.groupBy("corr_id", "group").agg(
        F.sum(F.when(F.col("kind").isin("count", "sum"), F.greatest(F.coalesce("count", F.lit(1)), F.lit(1)))).alias("merge_n"),
        F.sum(F.when(F.col("kind") == "sum", F.col("numeric"))).alias("merge_sum"),
        F.count_distinct(F.when(F.col("kind") == "distinct", F.col("value"))).alias("distinct_values"),
        F.bit_or(F.when(F.col("kind") == "seen", F.col("seen_mask"))).alias("merge_seen"),
        F.max("ts").alias("ts"),
    )
