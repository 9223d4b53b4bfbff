"""Contributions: partial aggregates that instances send to a group's owner.

On the wire a contribution is a JSON object of version 1 with a kind, the
correlation's id, a time, the group's values and what its kind carries. Another
version, an unknown kind or a missing id is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ownership import owner_key
from ..plans.model import Correlation

KINDS = ("count", "sum", "distinct", "seen")
SCHEMA = (
    "v int, kind string, corr_id string, ts double, group array<string>, count long, numeric double, value string, "
    "seen_mask long, origin string, key string"
)
#: What each type can send; the others are evaluated where their events are.
KIND_OF = {"event_count": "count", "value_sum": "sum", "value_avg": "sum", "value_count": "distinct", "temporal": "seen"}


def kind_for(c: Correlation) -> str | None:
    return KIND_OF.get(c.type)


def decode(df: DataFrame, json: str = "value") -> DataFrame:
    """The contributions among df's JSON texts, as columns."""
    version = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), "$.v", "variant"))
    text = lambda k: F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), f"$.{k}", "variant")) == "STRING"
    good = (version == "BIGINT") & text("kind") & text("corr_id")
    rows = df.where(F.coalesce(good, F.lit(False))).select(F.from_json(json, SCHEMA).alias("c")).select("c.*")
    rows = rows.where((F.col("v") == 1) & F.col("kind").isin(*KINDS))
    return rows.withColumn("ts", F.coalesce("ts", F.lit(0.0))).withColumn(
        "group", F.transform(F.coalesce("group", F.array().cast("array<string>")), lambda g: F.coalesce(g, F.lit("")))
    )


def encode(df: DataFrame) -> DataFrame:
    """One JSON text (value) for each contribution row; events and rows without an
    id have no wire form and are left out."""
    have = set(df.columns)
    col = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    rows = df.where(F.col("kind").isin(*KINDS) & (F.coalesce("corr_id", F.lit("")) != ""))
    kind, count = F.col("kind"), F.greatest(F.coalesce(col("count", "long"), F.lit(1)), F.lit(1))
    group = F.transform("group", lambda g: F.coalesce(g, F.lit("")))
    key = F.array_join(F.concat(F.array("corr_id"), group), "\t")
    return rows.select(
        F.to_json(
            F.struct(
                F.lit(1).alias("v"),
                "kind",
                "corr_id",
                "ts",
                group.alias("group"),
                key.alias("key"),
                F.when(kind.isin("count", "sum"), count).alias("count"),
                F.when(kind == "sum", F.coalesce(col("numeric", "double"), F.lit(0.0))).alias("numeric"),
                F.when(kind == "seen", col("seen_mask", "long")).alias("seen_mask"),
                F.when(kind == "distinct", col("value", "string")).alias("value"),
                F.when(F.coalesce(col("origin", "string"), F.lit("")) != "", col("origin", "string")).alias("origin"),
            )
        ).alias("value")
    )


__all__ = ["KINDS", "KIND_OF", "SCHEMA", "decode", "encode", "kind_for", "owner_key"]
