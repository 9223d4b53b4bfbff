"""Approximate nearest neighbours by balanced posting lists.

Fitting, on the driver: balanced k-means on a bounded sample (SAMPLE vectors)
gives the centroids, one for about LIST vectors of the table and MAX_LISTS at
most; each centroid is linked to its nearest ones, and best-first search over
that graph finds the centroids near a vector. Both the centroids and the graph
have a fixed bound, so they are broadcast.

Indexing covers every vector: it goes to the list of its nearest centroid, and
a vector on a boundary also to the next ones, up to COPIES in all, whose
distance is at most BOUNDARY times the nearest one's. Searching visits the
lists whose centroids are within RATIO times the distance of the query's
nearest centroid, `visits(lists)` of them at most: LISTS, and more with the
square root of the number of lists, as a fixed number finds less and less of a
growing table. Long lists are cut into blocks; a block and the queries that
visit it meet in one task, which compares the original vectors in double
precision. Queries that found fewer than k search again, WIDER times as many
lists whatever their distance, until they have k or have visited every list.

Equal vectors are one entry that holds its smallest k + 1 identifiers (more
could not be among any query's k nearest), and equal queries are one search.
Vectors that are null, zero, or hold null or non-finite components take no
part, nor do those whose length is not the table's most frequent one. Ties go
to the smaller identifier. A row whose identifier occurs again counts as its
own candidate only under another identifier. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage

#: Vectors that the centroids are fitted on, and lists at most.
SAMPLE, MAX_LISTS = 20_000, 8_192
#: Vectors of a list, about; blocks of a list and of its queries in one task.
LIST, BLOCK, QUERY_BLOCK = 400, 4_000, 4_000
COPIES, BOUNDARY = 4, 1.15
#: Lists that a query visits of FEW_LISTS or fewer, how far they may be, and how
#: many times as many a query visits that found too few.
LISTS, FEW_LISTS, RATIO, WIDER = 48, 128, 1.35, 4
#: Links of a centroid in the graph; how many best centroids a search keeps.
DEGREE, BEAM = 24, 32


def visits(lists: int) -> int:
    """How many lists a query visits at first."""
    return min(lists, int(np.ceil(LISTS * max(1.0, lists / FEW_LISTS) ** 0.5)))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)
    return np.sqrt(np.maximum(d, 0))


def balanced_centroids(vectors: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k-means whose distances are lengthened by a cluster's size, so that sizes even out."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), k, replace=False)].copy()
    fair, weight = len(vectors) / k, np.zeros(k)
    for _ in range(rounds):
        own = np.empty(len(vectors), np.int64)
        for at in range(0, len(vectors), 2_000):
            own[at : at + 2_000] = (distances(vectors[at : at + 2_000], centres) + weight).argmin(1)
        sizes = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        some = sizes > 0
        centres[some] = sums[some] / sizes[some, None]
        empty = np.flatnonzero(~some)
        centres[empty] = vectors[rng.choice(len(vectors), len(empty))]
        spread = np.linalg.norm(vectors - centres[own], axis=1).mean()
        weight += 0.05 * spread * (np.minimum(sizes / fair, 4) - 1)
    return centres


@dataclass
class Graph:
    """Centroids, and links from each to its nearest ones (and back)."""

    centres: np.ndarray
    links: list[np.ndarray]
    entries: np.ndarray

    @classmethod
    def of(cls, centres: np.ndarray, degree: int = DEGREE) -> "Graph":
        k = len(centres)
        out: list[set[int]] = [set() for _ in range(k)]
        for at in range(0, k, 1_000):
            near = np.argsort(distances(centres[at : at + 1_000], centres), axis=1)[:, 1 : degree + 1]
            for i, row in enumerate(near.tolist(), at):
                out[i].update(row)
                for j in row:
                    out[j].add(i)
        starts = np.linspace(0, k - 1, min(k, 16)).astype(np.int64)
        return cls(centres, [np.array(sorted(s - {i}), np.int64) for i, s in enumerate(out)], starts)

    def search(self, v: np.ndarray, beam: int = 3 * BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids found and their distances, nearest first."""
        seen = np.zeros(len(self.centres), bool)
        best: list[tuple[float, int]] = []  # the beam, farthest first
        turn: list[tuple[float, int]] = []

        def look(ids: np.ndarray) -> None:
            ids = ids[~seen[ids]]
            if not len(ids):
                return
            seen[ids] = True
            diff = self.centres[ids] - v
            for d, i in zip(np.sqrt((diff * diff).sum(1)).tolist(), ids.tolist(), strict=True):
                if len(best) < beam or d < -best[0][0]:
                    heapq.heappush(turn, (d, i))
                    heapq.heappush(best, (-d, i))
                    if len(best) > beam:
                        heapq.heappop(best)

        look(self.entries)
        while turn:
            d, i = heapq.heappop(turn)
            if len(best) == beam and d > -best[0][0]:
                break
            look(self.links[i])
        found = sorted((-d, i) for d, i in best)
        return np.array([i for _, i in found]), np.array([d for d, _ in found])


def usable(vector: Column) -> Column:
    """The vector as doubles, or null where it takes no part."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(v, lambda x: x == 0)
    return F.when(~F.coalesce(bad, F.lit(True)) & ~F.coalesce(zero, F.lit(True)), v)


def _distinct(df: DataFrame, vec_id: str, vector: str, k: int, is_query: Column) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (v, ids, asked), and the queries (query_id, v)."""
    rows = df.select(
        F.col(vec_id).cast("long").alias("id"), usable(F.col(vector)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    ).where("v is not null and id is not null")
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (size["n"] if size else 0))
    # The first k + 1 of each vector: cut down before they are shuffled, too.
    first = Window.partitionBy("v").orderBy("id")
    few = rows.select("v", "id").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    entries = few.groupBy("v").agg(F.array_distinct(F.sort_array(F.collect_list("id"))).alias("ids"))
    queries = rows.where("q").select(F.col("id").alias("query_id"), "v").distinct()
    return entries, queries


def _routed(df: DataFrame, graph, keep: list[str], copies: int, ratio: float | None) -> DataFrame:
    """A row for each list that a vector goes to: the nearest, and others by distance
    ratio. Without a ratio they are the nearest by all centroids, not by the graph."""
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("list", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph.value
        for batch in batches:
            vectors = np.array(batch.column("v").to_pylist(), np.float64)
            rows, lists = [], []
            for i, v in enumerate(vectors):
                if ratio is None:
                    near = np.argsort(distances(v[None], g.centres)[0], kind="stable")[:copies]
                else:
                    ids, d = g.search(v, max(BEAM, 2 * copies))  # narrow for indexing
                    near = ids[:copies][d[:copies] <= ratio * d[0] + 1e-12]
                rows += [i] * len(near)
                lists += near.tolist()
            part = batch.select(keep).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(lists, pa.int32())], names=[*keep, "list"]
            )

    return df.select(*keep).mapInArrow(run, schema)


def _answers(posted: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """s, near: the k + 1 nearest of each search in the lists that it visits."""
    # How many blocks each list and its queries are cut into (a row for each list).
    sizes = posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    sizes = sizes.join(
        visits.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("shares")), "list"
    )
    left = posted.join(F.broadcast(sizes), "list").select(
        "list",
        F.pmod(F.xxhash64("ids"), F.col("blocks")).alias("b"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("c"),
        F.lit(False).alias("asks"), F.lit(0).cast("long").alias("s"), "v", "ids",
    )
    right = visits.join(F.broadcast(sizes), "list").select(
        "list",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"),
        F.pmod(F.xxhash64("s"), F.col("shares")).alias("c"),
        F.lit(True).alias("asks"), "s", "v", F.lit(None).cast("array<long>").alias("ids"),
    )

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        asks, held = part[part["asks"]], part[~part["asks"]]
        out: list[tuple[int, int, float]] = []
        if len(asks) and len(held):
            base = np.array(held["v"].tolist(), np.float64)
            ids = held["ids"].tolist()
            for s, v in zip(asks["s"], asks["v"], strict=True):
                diff = base - np.asarray(v, np.float64)
                d = np.sqrt((diff * diff).sum(1))
                m = min(k + 1, len(d))
                limit = np.partition(d, m - 1)[m - 1]
                near = [(float(d[i]), int(x)) for i in np.flatnonzero(d <= limit) for x in ids[i]]
                out += [(int(s), x, y) for y, x in heapq.nsmallest(k + 1, near)]
        return pd.DataFrame(out, columns=["s", "vec_id", "score"])

    found = left.unionByName(right).groupBy("list", "b", "c").applyInPandas(
        compare, "s long, vec_id long, score double"
    )
    # Boundary copies are found in several lists.
    best = Window.partitionBy("s").orderBy("score", "vec_id")
    found = found.distinct().withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    return found.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))


def search(
    df: DataFrame,
    is_query: Column,
    k: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    list_size: int = LIST,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query.
    list_size: vectors of a list, about, as long as MAX_LISTS lists are enough."""
    spark = df.sparkSession
    entries, queries = _distinct(df, vec_id, vector, k, is_query)
    entries = cut_lineage(entries.withColumn("e", F.xxhash64("v")))
    n = entries.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    share = min(1.0, 1.3 * SAMPLE / n)
    drawn = entries.where(F.pmod("e", F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("e", "v")
    sample = np.array([r["v"] for r in drawn.orderBy("e").limit(SAMPLE).collect()], np.float64)
    lists = int(min(MAX_LISTS, len(sample), max(1, n // list_size)))
    graph = spark.sparkContext.broadcast(Graph.of(balanced_centroids(sample, lists)))

    posted = cut_lineage(_routed(entries, graph, ["v", "ids"], COPIES, BOUNDARY))
    searches = queries.groupBy("v").agg(F.lit(1).alias("one")).withColumn("s", F.xxhash64("v")).select("s", "v")
    wide, ratio, answers = visits(lists), RATIO, None
    while True:
        found = cut_lineage(_answers(posted, cut_lineage(_routed(searches, graph, ["s", "v"], wide, ratio)), k))
        answers = found if answers is None else answers.unionByName(found)
        if lists == 1 or ratio is None and wide == lists:
            break
        # k + 1 found hold k others. Who found fewer looks farther, in the end everywhere.
        enough = answers.where(F.size("near") > k)
        searches = cut_lineage(searches.join(enough, "s", "left_anti"))
        if searches.isEmpty():
            break
        answers, wide, ratio = enough, min(lists, WIDER * wide), None
    own = queries.select("query_id", F.xxhash64("v").alias("s")).join(answers, "s")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )
