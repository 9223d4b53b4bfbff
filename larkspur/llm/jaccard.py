"""Exact Jaccard join of word-shingle sets by T-occurrence search.

Two documents link when percent/100 or more of the union of their sets is
shared. A partner of a set of n shingles occurs in at least T of its n
inverted lists. The search for such partners goes from coarse to exact:

1. Documents with equal sets become one node.
2. Of each set the shingles with the smallest hashes are kept, n - T + n/20
   of them, or n - T + EXTRA: partners share about n/20 of these, or EXTRA.
   Document frequencies among
   them are counted (over all documents), and of each set the rarest of these
   are its short lists; a partner is on one of them. Sets whose short lists
   hold nobody else are done, which are nearly all but the near copies. (With n/20
   alone short texts that share a fifth with others, in a passage or a line, are
   on each other's lists, and what these connect grows faster than the input.)
3. What short lists connect, directly or not, is one block. Common passages can make
   large blocks of texts that are no partners, so these are split by parts of whole
   sets: the hashes are dealt to 2 d buckets, d being what two partners may differ
   by; partners have d equal buckets at least, so of each set the d + 1 rarest are
   lists as in 2. (d holds for a band of sizes; a set is in its own and the next one.)
   What these connect are the final blocks. A block's texts
   meet in one task, and there DivideSkip finds the partners (of large blocks
   the pieces have a task each, to which a few leaders also go; then only what is
   outside the largest component found so far meets the other pieces): the shortest lists of a
   set are merged by a heap of their heads, which skips what can't be on enough
   of them, and the long ones are probed by binary search for the candidates
   that are left. Members of the set's own component are left out of the lists.
4. The links found join nodes to components.

No component is lost: each step keeps every pair that reaches the threshold, up
to those that are in one component already. So links within a component are not
enumerated, and how many links a document has is not known.
Nodes are 64-bit hashes of whole sets.

A null or empty text, or one without words, has an empty set and links with
nothing. Repeated rows and equal texts share a component. A null doc_id is
passed through; such a row's component is the smallest doc_id linked to it.
Identifiers of any type that has an order will do. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .common import cut_lineage, give_back_memory, map_texts, remove_written, text_or_empty, written
from .components import connected_components

#: Shingles of a piece of a large block, and of the small blocks that share a task.
TASK_SHINGLES, SHARED_SHINGLES = 200_000, 100_000
#: Large blocks (some 60 bytes each) that are broadcast rather than shuffled.
FEW_BLOCKS = 100_000
#: Rows to be decided (some 20 bytes each) that are broadcast to the texts, likewise.
FEW_ROWS = 500_000
#: Shingles that partners share of what is kept of their sets, at least, where these have as many.
EXTRA = 40
#: Buckets that a large block's sets are dealt to, for each shingle that partners may differ by.
BUCKETS = 2
#: What a merged posting costs beside a probed one, as in DivideSkip.
MU = 0.0085


def occurrences(n: int, percent: int) -> int:
    """T: shared shingles of a set of n with any partner, at least."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    """Partners of n shingles or more share min(T, max(n/20, EXTRA)) of their prefixes, at least."""
    return min(n, n - occurrences(n, percent) + max(-(-n // 20), EXTRA))


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def size_bands(percent: int, size: int) -> list[tuple[int, int]]:
    """Smallest and largest sizes of bands, up to that next to the band of `size`:
    partners are in one band or in neighbouring ones."""
    bands, low = [], 1
    while len(bands) < 2 or bands[-2][1] < size:
        bands.append((low, low * 100 // percent))
        low = bands[-1][1] + 1
    return bands


def bucket_tokens(s: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """For a set's band and the next one: d, by how many shingles partners of that band
    or smaller ones differ at most, and a token of the content of each of BUCKETS * d
    buckets. Partners share a band's d, and all but d of its tokens."""
    bands, out = size_bands(percent, len(s)), []
    for band in (len(bands) - 2, len(bands) - 1):
        d = 2 * bands[band][1] * (100 - percent) // (100 + percent)
        m = max(1, BUCKETS * d)
        content = np.zeros(m, np.uint64)
        np.add.at(content, (shingles.mix(s) % np.uint64(m)).astype(np.int64), shingles.mix(~s))
        name = shingles.mix(np.arange(m, dtype=np.uint64) + np.uint64(band << 32))
        out.append((d, _signed(shingles.mix(content + name))))
    return out


def _signed(s: np.ndarray) -> np.ndarray:
    return s.view(np.int64)


def document_sets(df: DataFrame, k: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, node, prefix of every document."""

    def kernel():
        def run(texts):
            sets = shingles.shingle_sets(pa.array(texts, pa.string()), k)
            return {
                "n_shingles": [len(s) for s in sets],
                "node": [node_of(s) if len(s) else None for s in sets],
                "prefix": [_signed(s[: prefix_length(len(s), percent)]) for s in sets],
            }

        return run

    fields = [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("node", T.LongType()),
        T.StructField("prefix", T.ArrayType(T.LongType())),
    ]
    named = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return map_texts(named, kernel, fields, ["doc_id", "text_hash"])


class Links:
    """Components of the sets of one task, kept as a label for each set."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members: dict[int, list[int]] = {}

    def join(self, x: int, y: int) -> None:
        a, b = int(self.label[x]), int(self.label[y])
        if a == b:
            return
        own, other = (self.members.setdefault(i, [i]) for i in (a, b))
        if len(own) < len(other):
            a, b, own, other = b, a, other, own
        self.label[other] = a
        own.extend(other)
        del self.members[b]


def merge_skip(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """What stands on `least` or more of the ascending lists, and on how many: by a
    heap of the lists' heads. Lists whose head can't be on enough of them are wound
    forward by binary search."""
    n = len(lists)
    if n < least:
        return []
    # A head and its list's number in one integer, which compares fast.
    heap = [x[0] * n + i for i, x in enumerate(lists)]
    heapq.heapify(heap)
    at, end, out = [0] * n, [len(x) for x in lists], []
    pop, replace = heapq.heappop, heapq.heapreplace
    while len(heap) >= least:
        top = heap[0] // n
        after, popped = (top + 1) * n, []
        while heap and heap[0] < after and len(popped) < least:
            popped.append(pop(heap) % n)
        if len(popped) == least:
            count = least
            while heap and heap[0] < after:  # the others of this one go on at once
                i = heap[0] % n
                count += 1
                at[i] += 1
                if at[i] < end[i]:
                    replace(heap, lists[i][at[i]] * n + i)
                else:
                    pop(heap)
            out.append((top, count))
            to = top + 1
        else:
            while heap and len(popped) < least - 1:
                popped.append(pop(heap) % n)
            if not heap:
                break
            to = heap[0] // n
        for i in popped:
            k = at[i] + 1
            if k < end[i] and lists[i][k] < to:
                k = bisect_left(lists[i], to, k)
            elif lists[i][at[i]] >= to:
                k = at[i]
            at[i] = k
            if k < end[i]:
                heapq.heappush(heap, lists[i][k] * n + i)
    return out


class Inverted:
    """The inverted lists of a task's sets: for each shingle, from the rarest to the
    most frequent, the sets that hold it. Sets are numbered by size."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = np.argsort([len(s) for s in sets], kind="stable")
        self.sizes = np.array([len(sets[i]) for i in self.order], np.int64)
        self.m = m = len(sets)
        ends = np.cumsum(self.sizes)
        _, token, often = np.unique(np.concatenate([sets[i] for i in self.order]), return_inverse=True, return_counts=True)
        rank = np.empty(len(often), np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(len(often))
        token = rank[token]
        self.rows = [np.sort(token[e - n : e]) for e, n in zip(ends, self.sizes, strict=True)]
        #: shingle * m + set, ascending: all lists one after another, searched as one.
        self.postings = np.sort(token * m + np.repeat(np.arange(m), self.sizes))
        self.length = np.sort(often, kind="stable")
        self.begin = np.cumsum(self.length) - self.length

    def before(self, token: int, x: int) -> np.ndarray:
        """The sets numbered below x on a shingle's list."""
        a, n = int(self.begin[token]), int(self.length[token])
        part = self.postings[a : a + n]
        return part[: np.searchsorted(part, token * self.m + x)] - token * self.m

    def probe(self, tokens: np.ndarray, y: int) -> int:
        """On how many of the shingles' lists y stands, by binary search in each."""
        wanted = tokens * self.m + y
        at = np.searchsorted(self.postings, wanted)
        return int((self.postings[np.minimum(at, len(self.postings) - 1)] == wanted).sum())


def search(sets: list[np.ndarray], percent: int, known: list | None = None) -> np.ndarray:
    """Labels of the components of sets, by T-occurrence search with DivideSkip. Sets
    of equal `known` are in one component from the start.

    Of a set's lists the longest, T / (MU log M + 1) of them (M: the longest one's
    length), are probed and the others merged."""
    links = Links(len(sets))
    if len(sets) < 2 or not sum(map(len, sets)):
        return links.label
    index = Inverted(sets)
    sizes, rows = index.sizes, index.rows
    if known is not None:
        place: dict[object, int] = {}
        for x, i in enumerate(index.order):
            links.join(place.setdefault(known[i], x), x)

    def linked(x: int, y: int, shared: int) -> bool:
        return 100 * shared >= percent * (int(sizes[x]) + int(sizes[y]) - shared)

    for x in range(index.m):
        n = int(sizes[x])
        if not n:
            continue
        row = rows[x]
        fewest = int(sizes[np.searchsorted(sizes, occurrences(n, percent))])  # of a partner's shingles
        t = -(-percent * (n + fewest) // (100 + percent))
        if int((index.length[row] > 1).sum()) < t:
            continue
        probed = min(t - 1, int(t / (MU * math.log(int(index.length[row[-1]]) + 1) + 1)))
        least = t - probed
        short, long = row[: n - probed], row[n - probed :]
        lists = [index.before(int(s), x) for s in short if index.length[s] > 1]
        lists = [v[links.label[v] != links.label[x]] for v in lists]
        lists = [v for v in lists if len(v)]
        if len(lists) < least:
            continue
        # Who stands last on most lists is tried first: the others of its component
        # needn't be merged then.
        last, count = np.unique([v[-1] for v in lists], return_counts=True)
        y = int(last[count.argmax()])
        if sizes[y] >= fewest and linked(x, y, index.probe(row, y)):
            links.join(x, y)
            lists = [v[links.label[v] != links.label[x]] for v in lists]
        found = merge_skip([v.tolist() for v in lists if len(v)], least)
        for y, count in sorted(found, key=lambda f: -f[1]):
            m = int(sizes[y])
            needed = -(-percent * (n + m) // (100 + percent))
            if m < fewest or count + len(long) < needed or links.label[y] == links.label[x]:
                continue
            if linked(x, y, count + index.probe(long, y)):
                links.join(x, y)
    label = np.empty(index.m, np.int64)
    label[index.order] = index.order[links.label]
    return label


def _nodes_once(sets: DataFrame) -> DataFrame:
    """node, n, prefix of every node, once. Only nodes of several rows are shuffled."""
    rows = sets.where("node is not null").select("node", F.col("n_shingles").alias("n"), "prefix")
    again = rows.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    again = cut_lineage(again.select(F.col("node").alias("of")))
    again = F.broadcast(again) if again.count() <= FEW_ROWS else again
    same = rows["node"] == again["of"]
    once = cut_lineage(rows.join(again, same, "left_semi").dropDuplicates(["node"]))
    return rows.join(again, same, "left_anti").unionByName(once)


def _shared(rows: DataFrame, unit: list[str]) -> DataFrame:
    """unit, n, shared: the tokens that others have too, rarest first, with often."""
    common = cut_lineage(rows.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often > 1"))
    return rows.join(common, "token").groupBy(*unit).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("often", "token"))).alias("shared")
    )


def _short_lists(shared: DataFrame, kept: Column, wanted: Column) -> DataFrame:
    """node, n, token, often: the `wanted` rarest tokens of the `kept` ones, where shared."""
    free = wanted - (kept - F.size("shared"))
    return shared.where(free > 0).select(
        "node", "n", F.explode(F.slice("shared", F.lit(1), free.cast("int"))).alias("s")
    ).select("node", "n", F.col("s.token").alias("token"), F.col("s.often").alias("often"))


def _candidates(reps: DataFrame, percent: int) -> DataFrame:
    """node, n, token, often: the short lists that somebody else may be on."""
    shared = _shared(reps.select("node", "n", F.explode("prefix").alias("token")), ["node"])
    n = F.col("n")
    t = -F.floor(-n * percent / 100)
    kept = F.least(n, n - t + F.greatest(-F.floor(-n / 20), F.lit(EXTRA)))
    # A partner has T shingles at least, and so shares as many of the kept ones as two sets of that size do.
    same = F.least(-F.floor(-t * percent / 100), F.greatest(-F.floor(-t / 20), F.lit(EXTRA)))
    return _short_lists(shared, kept, kept - same + 1)


def _split(pieces: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """node, n, block, score: small blocks as they are, and large ones split by the buckets
    of their sets, as `texts` (node, text, large) have them."""

    def kernel():
        def run(texts):
            sets = shingles.shingle_sets(pa.array(texts, pa.string()), k)
            both = [bucket_tokens(s, percent) for s in sets]
            return {
                "n": [len(s) for s in sets],
                "bands": [[{"d": d, "tokens": tokens} for d, tokens in b] for b in both],
            }

        return run

    band = T.StructType([T.StructField("d", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))])
    fields = [T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(band))]
    rows = map_texts(texts.where("large"), kernel, fields, ["node"]).dropDuplicates(["node"])  # a text may be repeated
    rows = rows.select("node", "n", F.posexplode("bands").alias("band", "b"))
    rows = cut_lineage(rows.select("node", "n", "band", "b.d", F.explode("b.tokens").alias("token")))
    shared = _shared(rows, ["node", "band", "d"])
    candidates = cut_lineage(_short_lists(shared, F.greatest(F.lit(1), BUCKETS * F.col("d")), F.col("d") + 1))
    return pieces.where("parts <= 1").select("node", "n", "block", "score").union(_blocks(candidates))


def _blocks(candidates: DataFrame) -> DataFrame:
    """node, n, block, score of what short lists connect; the score is how many others
    a node shares its short lists with."""
    lists = candidates.groupBy("token").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    edges = candidates.join(lists.drop("c"), "token").where("node != first").select("node", "first", "n").distinct()
    edges = cut_lineage(edges)
    label = connected_components(edges, "node", "first")
    sizes = candidates.groupBy("node").agg(F.first("n").alias("n"), F.avg("often").alias("score"))
    return label.join(sizes, "node").select("node", "n", F.col("component").alias("block"), "score")


def _pieces(blocks: DataFrame, task_shingles: int) -> DataFrame:
    """blocks with parts, piece (of that many, by the node's hash) and leaders: a few
    nodes of a large block, first of all that which shares most with the others."""
    weight = blocks.groupBy("block").agg(
        F.ceil(F.sum("n") / task_shingles).alias("parts"),
        F.array_distinct(F.array(F.max_by("node", F.struct("score", "node")), F.min("node"), F.max("node"))).alias("leaders"),
    )
    # Large blocks are few (each has task_shingles at least), and one may hold most nodes.
    large = cut_lineage(weight.where("parts > 1"))
    large = F.broadcast(large) if large.count() <= FEW_BLOCKS else large
    rows = blocks.join(large, "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    return rows.withColumn("piece", F.pmod(F.xxhash64("node"), F.col("parts")))


def _first_tasks(pieces: DataFrame, task_shingles: int) -> DataFrame:
    """node, task, known: small blocks share tasks; a large block's pieces have one
    each, and its leaders go to all of them."""
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = max(1, -(-total // min(task_shingles, SHARED_SHINGLES)))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda i: F.xxhash64("block", i))
    where = (
        F.when(F.col("parts") <= 1, F.array(F.pmod(F.xxhash64("block"), F.lit(groups))))
        .when(F.array_contains("leaders", F.col("node")), every)
        .otherwise(F.array(F.xxhash64("block", "piece")))
    )
    return pieces.select("node", F.explode(where).alias("task"), F.col("node").alias("known"))


def _second_tasks(pieces: DataFrame, components: DataFrame, task_shingles: int) -> DataFrame:
    """node, task, known: what the first tasks have left of large blocks. The nodes
    outside a block's largest component so far, in chunks, meet each of its pieces;
    pairs within that component are known already."""
    large = pieces.where("parts > 1").join(components, "node", "left")
    large = cut_lineage(large.select("node", "n", "block", "parts", "piece", F.coalesce("component", "node").alias("known")))
    main = large.groupBy("block", "known").agg(F.count(F.lit(1)).alias("nodes"))
    main = main.groupBy("block").agg(F.max_by("known", F.struct("nodes", "known")).alias("main"))
    few = large.select("block").distinct().count() <= FEW_BLOCKS
    spread = F.broadcast if few else lambda x: x
    large = large.join(spread(main), "block").withColumn("out", F.col("known") != F.col("main"))
    left = large.where("out").groupBy("block").agg(F.ceil(F.sum("n") / task_shingles).alias("chunks"))
    rows = large.join(spread(left), "block")
    chunk = F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("chunks"))
    here = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda c: F.xxhash64("block", "piece", c))
    there = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda i: F.xxhash64("block", i, chunk))
    where = F.when(F.col("out"), F.array_union(here, there)).otherwise(here)
    return rows.select("node", F.explode(where).alias("task"), "known")


def _texts_of(df: DataFrame, nodes: DataFrame, pieces: DataFrame, doc_id: str, text: str) -> DataFrame:
    """node, doc_id, text of the rows of df that stand for the nodes of a block, and whether
    it is a large one. All texts are shuffled for this, once; what the tasks read afterwards
    is these rows alone."""
    wanted = pieces.select("node", (F.col("parts") > 1).alias("large")).join(nodes, "node").select("node", "large", "first.*")
    texts = df.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    same = texts["doc"].eqNullSafe(wanted["doc_id"]) & (texts["hash"] == wanted["text_hash"])
    return texts.join(wanted, same).select("node", "doc_id", "text", "large")


def links(df: DataFrame, nodes: DataFrame, tasks: DataFrame, k: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """node, other: links that span the components of each task's texts; what is known
    to be in one component already (equal `known`) isn't compared."""
    texts = df.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("hash"), text_or_empty(text).alias("text"))
    wanted = tasks.join(nodes, "node").select("task", "node", "known", "first.*")
    same = texts["doc"].eqNullSafe(wanted["doc_id"]) & (texts["hash"] == wanted["text_hash"])
    rows = texts.join(wanted, same).select("task", "node", "known", "text")

    def find(rows: pa.Table) -> pa.Table:
        sets = shingles.shingle_sets(rows.column("text").combine_chunks(), k)
        nodes, known = rows.column("node").to_pylist(), rows.column("known").to_pylist()
        mine = dict(zip(nodes, zip(sets, known, strict=True), strict=True))  # a row may be repeated
        del sets
        ids = np.array(sorted(mine), np.int64)
        sets, known = [mine[int(i)][0] for i in ids], [mine[int(i)][1] for i in ids]
        mine.clear()
        other = ids[search(sets, percent, known)] if len(ids) else ids
        del sets
        give_back_memory()
        linked = ids != other
        return pa.table({"node": ids[linked], "other": other[linked]})

    return rows.groupBy("task").applyInArrow(find, "node long, other long")


def _linked(
    df: DataFrame, k: int, percent: int, doc_id: str, text: str, task_shingles: int
) -> tuple[DataFrame, DataFrame]:
    """document_sets, and node, first (doc_id and text_hash of its first row), component."""
    full, path = written(document_sets(df, k, percent, doc_id, text), "sets")
    sets = cut_lineage(full.drop("prefix"))
    candidates = cut_lineage(_candidates(_nodes_once(full), percent))
    remove_written(df.sparkSession, path)
    blocks = cut_lineage(_blocks(candidates))
    named = sets.where("node is not null")
    # Null identifiers come last.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = named.groupBy("node").agg(F.min(order).alias("first"))
    pieces = cut_lineage(_pieces(blocks, task_shingles))
    texts, path = written(_texts_of(df, nodes, pieces, doc_id, text), "block-texts")
    if not pieces.where("parts > 1").isEmpty():
        pieces = cut_lineage(_pieces(cut_lineage(_split(pieces, texts, k, percent)), task_shingles))
    found = cut_lineage(links(texts, nodes, _first_tasks(pieces, task_shingles), k, percent, "doc_id", "text"))
    if not pieces.where("parts > 1").isEmpty():
        second = cut_lineage(_second_tasks(pieces, connected_components(found, "node", "other"), task_shingles))
        if not second.isEmpty():
            found = found.union(links(texts.where("large"), nodes, second, k, percent, "doc_id", "text"))
    joined = connected_components(found, "node", "other")
    remove_written(df.sparkSession, path)
    return sets, nodes.join(joined, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))


def link_components(
    df: DataFrame,
    k: int = 5,
    percent: int = 80,
    doc_id: str = "doc_id",
    text: str = "text",
    task_shingles: int = TASK_SHINGLES,
) -> DataFrame:
    """doc_id, n_shingles (size of the set), component_id (smallest doc_id reachable by links)."""
    sets, label = _linked(df, k, percent, doc_id, text, task_shingles)
    smallest = label.groupBy("component").agg(F.min("first.doc_id").alias("component_id"))
    members = label.join(smallest, "component").select("node", "component_id")
    return sets.join(members, "node", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(
    df: DataFrame,
    k: int = 5,
    percent: int = 80,
    doc_id: str = "doc_id",
    text: str = "text",
    task_shingles: int = TASK_SHINGLES,
    few: int = FEW_ROWS,
) -> DataFrame:
    """df without near copies: of the rows that links connect one stays, that with the
    smallest doc_id (null ones come last) and, of equal ones, the smallest text hash.
    Rows are told apart by doc_id and text, never by doc_id alone. Rows with an empty
    set stay, all of them; columns of any name pass through.

    Only rows that go, or that are repeated, are joined to the texts: up to FEW_ROWS of
    them, as counted, are broadcast and no text is shuffled for that; more are
    shuffled, and all texts with them, with the same result."""
    sets, label = _linked(df, k, percent, doc_id, text, task_shingles)
    kept = label.groupBy("component").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_hash")
    rows = sets.where("node is not null").groupBy("doc_id", "text_hash").agg((F.count(F.lit(1)) > 1).alias("again"))
    stays = rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows["text_hash"] == kept["text_hash"])
    judged = rows.join(kept, stays, "left").select(
        rows["doc_id"], rows["text_hash"], "again", kept["text_hash"].isNull().alias("gone")
    )
    judged, _ = written(judged.where("gone or again"), "near-copies")
    spread = F.broadcast if judged.count() <= few else lambda x: x
    row = F.struct("*").alias("__row")
    texts = df.select(row, F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__hash"))

    def same(found: DataFrame) -> Column:
        return texts["__id"].eqNullSafe(found["doc_id"]) & (texts["__hash"] == found["text_hash"])

    once = texts.join(spread(judged), same(judged), "left_anti").select("__row")
    repeated = judged.where("not gone")
    if not repeated.isEmpty():
        several = texts.join(spread(repeated), same(repeated), "left_semi")
        several = several.groupBy("__id", "__hash").agg(F.first("__row").alias("__row")).select("__row")
        once = once.union(several)
    return once.select(*[F.col("__row").getField(c).alias(c) for c in df.columns])
