"""Nearest neighbours against exact distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import neighbours


def exact(ids, vectors, q, k):
    d = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]]
    return [(int(ids[i]), float(d[i])) for i in order[:k]]


def frame(spark, ids, vectors):
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    vectors = (centres[rng.integers(12, size=2500)] + 0.6 * rng.normal(size=(2500, 24))).astype(np.float32)
    vectors[1000:1400] = vectors[7]  # a large group of equal vectors
    ids = rng.permutation(10_000)[:2500]
    got = neighbours.search(frame(spark, ids, vectors), F.col("vec_id") % 50 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    wide = vectors.astype(np.float64)
    place = {int(i): n for n, i in enumerate(ids)}
    assert set(by) == {int(i) for i in ids if i % 50 == 0}
    for q, rows in by.items():
        want = exact(ids, wide, place[q], 10)
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 11))
        assert sorted(rows, key=lambda r: (r[2], r[1])) == rows
        for _, v, score in rows:
            assert v != q and score == pytest.approx(float(np.sqrt(((wide[place[v]] - wide[place[q]]) ** 2).sum())), abs=1e-12)
        hits += len({v for _, v, _ in rows} & {v for v, _ in want})
        total += len(want)
    assert hits / total >= 0.9
    copies = sorted(int(ids[i]) for i in [7, *range(1000, 1400)])
    for q in (c for c in copies if c % 50 == 0):
        assert [v for _, v, _ in by[q]] == [c for c in copies if c != q][:10]


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.5]), (2, None), (100, [0.0, 0.0]), (3, [float("nan"), 1.0]), (150, [1.0, None]),
        (4, [float("inf"), 1.0]), (200, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0]), (250, []),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("ids", F.lit(2))
    got = [tuple(r) for r in neighbours.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    near = 0.5
    assert got == [(0, 1, 1, near), (0, 2, 50, 2**0.5), (50, 1, 1, pytest.approx(1.25**0.5)), (50, 2, 0, 2**0.5)]
    assert neighbours.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert neighbours.search(df.where("vec_id = 50"), F.col("vec_id") % 50 == 0).count() == 0


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(300, 8))
    graph = neighbours.Graph.of(centres)
    hits = 0
    for q in rng.normal(size=(100, 8)):
        found, d = graph.search(q)
        assert list(d) == sorted(d)
        hits += found[0] == ((centres - q) ** 2).sum(1).argmin()
    assert hits >= 98


def test_clusters_are_balanced():
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.normal(size=(1800, 6)) * 0.1, 5 + rng.normal(size=(200, 6))])
    centres = neighbours.balanced_centroids(vectors, 10)
    sizes = np.bincount(neighbours.distances(vectors, centres).argmin(1), minlength=10)
    assert sizes.max() <= 900


def test_visits_grow_with_the_lists():
    assert [neighbours.visits(n) for n in (1, 48, 128)] == [1, 48, 48]
    # 800,000 uniform unit vectors have 2,000 lists; fitted and searched on a sample of the near ones.
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(200_000, 64)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    centres = neighbours.balanced_centroids(vectors[:20_000].astype(np.float64), 2_000, rounds=3)
    found = []
    for q in range(60):
        d = ((vectors - vectors[q]) ** 2).sum(1)
        near = vectors[np.argpartition(d, 11)[:11]].astype(np.float64)
        d = neighbours.distances(near, centres)
        lists = np.argsort(neighbours.distances(vectors[q : q + 1].astype(np.float64), centres)[0])
        seen = set(lists[: neighbours.visits(2_000)].tolist())
        found += [bool(seen & set(row[: neighbours.COPIES].tolist())) for row in np.argsort(d, 1)]
    assert np.mean(found) >= 0.9


def test_small_far_groups_find_k(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(2_000, 8)).astype(np.float32)
    vectors[:3] = 500 + rng.normal(size=(3, 8))  # three vectors far from the rest, and one still farther
    vectors[3] = -3_000
    ids = np.arange(2_000)
    got = neighbours.search(frame(spark, ids, vectors), F.col("vec_id") < 4).collect()
    wide = vectors.astype(np.float64)
    for q in range(4):
        rows = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [r for r, _ in rows] == list(range(1, 11))
        assert {v for _, v in rows[:2]} == {v for v, _ in exact(ids, wide, q, 2)}


def test_recall_with_hundreds_of_lists(spark):
    """500 lists, of which a query visits a fifth; exact answers for all queries."""
    import pandas as pd

    rng = np.random.default_rng(17)
    base = rng.normal(size=(20_000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(20_000), "embedding": base.tolist()})).repartition(4)
    assert neighbours.visits(500) / 500 < 0.2
    found: dict[int, set[int]] = {}
    for r in neighbours.search(df, F.col("vec_id") % 100 == 0, list_size=40).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    right = 0
    for q in range(0, 20_000, 100):
        d = np.sqrt(((base - base[q]) ** 2).sum(1))
        d[q] = np.inf
        right += len(found[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert right / (10 * 200) >= 0.9, right / 2000
