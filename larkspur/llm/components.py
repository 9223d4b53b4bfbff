"""Connected components of an edge table, by alternating stars.

Each round links every node's larger neighbours to its smallest one, then
every node's smaller neighbours, until nothing changes: the number of rounds
grows with the logarithm of the number of nodes. All state is in DataFrames;
each round's edges go to the shared checkpoint folder. What has shrunk to a fixed
number of edges is finished in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: Edges (16 bytes each) that one task takes in.
FEW_EDGES = 500_000


def _stars(edges: DataFrame) -> DataFrame:
    """(u, v) -> (v, m) and (u, m), m the smallest of u and its neighbours v."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    smallest = smallest.select("u", F.least("u", "m").alias("m"))
    linked = edges.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = smallest.select("u", F.col("m").alias("v"))
    return linked.union(own)


def _finished(edges: DataFrame) -> DataFrame:
    """node, component of a graph of a bounded number of edges, in one task."""

    def run(batches):
        import pyarrow as pa

        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = root(u), root(v)
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        for at in range(0, max(1, len(nodes)), 100_000):
            part = nodes[at : at + 100_000]
            columns = [pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame, a: str, b: str, few: int = FEW_EDGES) -> DataFrame:
    """node long, component long (the smallest node) for every node of an edge.

    Loops and repeated edges don't matter; edges with a null end are left out.
    A graph that has shrunk to `few` edges is finished in one task.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = e.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e, before = cut_lineage(e), None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now[0] <= few:
            return cut_lineage(_finished(e))
        if now == before:
            break
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        small = _stars(large).where("u != v")
        e = cut_lineage(small.distinct())
    centres = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        centres.select("node", F.col("node").alias("component"))
    )
