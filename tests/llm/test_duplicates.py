"""Jaccard join, components and substring deduplication against brute force."""

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import chunks, common, components, jaccard, shingles


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingle_set(t, k):
    w = words(t)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows, k, percent):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            shared = len(x & y)
            if (x and y and 100 * shared >= percent * (len(x) + len(y) - shared)) or (i is not None and i == j and x == y):
                parent[root(a)] = root(b)
    out = []
    for a, (i, s) in enumerate(sets):
        members = [sets[b][0] for b in range(len(sets)) if root(b) == root(a) and sets[b][0] is not None]
        out.append((i, len(s), min(members) if members and s else i))
    return sorted(out, key=repr)


def corpus(seed, n=220):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.55:
            t = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            t = t[: len(t) - rng.choice([0, 0, 1, 3])] or ["w0"]
        else:
            t = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 12, 40, 90]))]
        if rng.random() < 0.3:
            t = t + passage
        texts.append(" ".join(t))
    return [(i, t.upper() if rng.random() < 0.1 else t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("k", "percent", "task"), [(4, 85, 10**6), (4, 85, 500), (5, 80, 10**6), (1, 60, 800)])
def test_components_of_links(spark, k, percent, task):
    rows = corpus(k * percent + task) + [(900, None), (901, ""), (902, " \t"), (None, "w1 w2 w3 w4 w5"), (None, None), (3, "another text of number three")]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.link_components(df, k, percent, task_shingles=task).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, k, percent)


def test_one_large_group(spark):
    rng = random.Random(9)
    base = [f"v{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(300):
        t = list(base)
        t[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, rows[0][1]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.link_components(df, 4, 85, task_shingles=2_000)
    assert {r["component_id"] for r in got.collect()} == {0}


def test_leaders_spare_the_pairs_of_pieces(spark):
    """A block of near copies of one text is done after the first tasks."""
    rng = random.Random(10)
    base = [f"v{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(400):
        t = list(base)
        t[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = jaccard.document_sets(df, 4, 85, "doc_id", "text")
    reps = sets.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix"))
    pieces = jaccard._pieces(jaccard._blocks(jaccard._candidates(reps, 85)), 6_000).cache()
    assert pieces.select(F.max("parts")).first()[0] >= 9
    nodes = sets.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    first = jaccard._first_tasks(pieces, 6_000)
    assert first.count() <= 400 + 3 * 11
    found = jaccard.links(df, nodes, first, 4, 85, "doc_id", "text")
    done = components.connected_components(found, "node", "other")
    assert done.select("component").distinct().count() == 1
    assert jaccard._second_tasks(pieces, done, 6_000).isEmpty()


def test_partners_share_bucket_tokens():
    """Of 2 d tokens partners of a band share all but d, wherever their sizes are."""
    rng = random.Random(11)
    for percent in (60, 80, 85, 100):
        for n in [*range(1, 60), 200, 317]:
            x = {rng.randrange(1 << 63) for _ in range(n)}
            y = set(x)
            while True:  # as far from x as a partner can be
                z = set(y)
                if rng.random() < 0.5 and len(z) > 1:
                    z.remove(min(z))
                else:
                    z.add(rng.randrange(1 << 63))
                shared = len(x & z)
                if 100 * shared < percent * (len(x) + len(z) - shared):
                    break
                y = z
            bands = []
            for one in (x, y):
                at = len(jaccard.size_bands(percent, len(one))) - 2
                tokens = jaccard.bucket_tokens(np.array(sorted(one), np.uint64), percent)
                bands.append({at + i: (d, set(t.tolist())) for i, (d, t) in enumerate(tokens)})
            band = max(map(min, bands))
            (d, a), (e, b) = bands[0][band], bands[1][band]
            assert d == e and len(a) == len(b) == max(1, jaccard.BUCKETS * d) and len(a & b) >= len(a) - d


def test_common_passages_do_not_multiply_texts(spark, monkeypatch):
    """Texts of a few common lines each share short lists, but few are near copies:
    they are not dealt to all pieces of one large block."""
    rng = random.Random(12)
    lines = [" ".join(f"l{i}x{j}" for j in range(12)) for i in range(40)]
    rows = [(i, " ".join([*rng.sample(lines, 4), *(f"u{i}x{j}" for j in range(8))])) for i in range(400)]
    rows += [(1000 + i, f"{rows[i][1]} more") for i in range(0, 400, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dealt, search = [], jaccard.links
    monkeypatch.setattr(jaccard, "links", lambda df, nodes, tasks, *a: dealt.append(tasks.count()) or search(df, nodes, tasks, *a))
    got = jaccard.link_components(df, 4, 85, task_shingles=2_000).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 4, 85)
    assert sum(dealt) <= 2 * len(rows)


def test_kept_shingles_of_partners():
    """Partners share what the short lists count on, of the shingles that are kept."""
    rng = random.Random(13)
    for percent in (60, 80, 85, 100):
        for n in [*range(1, 60), 200, 900]:
            x = sorted(rng.sample(range(1 << 40), n))
            shared = x[: jaccard.occurrences(n, percent)] if rng.random() < 0.5 else x[n - jaccard.occurrences(n, percent) :]
            kept = set(x[: jaccard.prefix_length(n, percent)])
            low = sorted({*shared, *range(-5 * n, 0)})  # others of y come first
            for y in (sorted(shared), low[-n:]):
                both = len(set(x) & set(y))
                if 100 * both < percent * (n + len(y) - both):
                    continue
                t = jaccard.occurrences(n, percent)
                same = min(jaccard.occurrences(t, percent), max(-(-t // 20), jaccard.EXTRA))
                assert len(kept & set(y[: jaccard.prefix_length(len(y), percent)])) >= same


@pytest.mark.parametrize(("k", "percent"), [(5, 80), (4, 85)])
def test_passages_in_short_texts_do_not_make_blocks(spark, k, percent):
    """Short texts with a third in common passages are in no block, however many there
    are; near copies of them are in blocks of two."""
    rng = random.Random(14)
    lines = [" ".join(f"l{i}x{j}" for j in range(14)) for i in range(30)]
    rows = [(i, " ".join([*rng.sample(lines, 2), *(f"u{i}x{j}" for j in range(56))])) for i in range(400)]
    rows += [(1000 + i, f"{rows[i][1]} more") for i in range(0, 400, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = jaccard.document_sets(df, k, percent, "doc_id", "text")
    blocks = jaccard._blocks(jaccard._candidates(jaccard._nodes_once(sets), percent))
    assert [r["count"] for r in blocks.groupBy("block").count().collect()] == [2] * 50
    got = jaccard.link_components(df, k, percent, task_shingles=2_000).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, k, percent)


def test_written_rows_leave_no_shuffles(spark):
    """Shuffle files go as soon as rows are written; the session's own setting is as before."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in map(str, spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles())) if "shuffle_" in f}
    before, had = spark.conf.get(key), shuffles()
    rows = common.cut_lineage(spark.range(1000).repartition(7, "id"))
    table, path = common.written(spark.range(1000).repartition(7, "id"), "numbers")
    for _ in range(50):  # files are deleted in the background
        if not shuffles() - had:
            break
        time.sleep(0.2)
    assert not shuffles() - had
    assert rows.count() == table.count() == 1000 and spark.conf.get(key) == before
    common.remove_written(spark, path)


def test_one_of_each_by_either_join(spark):
    """Decided rows are broadcast or shuffled to the texts; brute force says which stay."""
    rows = corpus(31, 120) + [(900, None), (901, ""), (None, "w1 w2 w3 w4 w5 w6"), (3, "another text of number three, apart")]
    rows += [rows[0], rows[0], rows[-2]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    smallest = {(i, c) for i, _, c in brute(rows, 5, 80)}
    for few, task in ((0, 400), (10**6, 10**6)):
        left = jaccard.one_of_each(df, 5, 80, task_shingles=task, few=few).collect()
        ids = Counter(r["doc_id"] for r in left)
        assert all(ids[i] == (1 if i == c else 0) for i, c in smallest if i not in (None, 3))
        assert ids[None] == 1 and (3, "another text of number three, apart") in {tuple(r) for r in left}


@pytest.mark.parametrize("seed", range(4))
def test_search_against_all_pairs(seed):
    rows = corpus(seed, 120)
    sets = [s for s in shingles.shingle_sets(pa.array([t for _, t in rows], pa.string()), 2) if len(s)]
    rng = random.Random(seed)
    known = [rng.choice([0, 1, *range(10, 10 + len(sets))]) for _ in sets]
    for percent, given in ((85, None), (60, None), (70, known)):
        parent = list(range(len(sets)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in range(len(sets)):
            for b in range(a):
                shared = len(set(sets[a].tolist()) & set(sets[b].tolist()))
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared) or given and given[a] == given[b]:
                    parent[root(a)] = root(b)
        label = jaccard.search(sets, percent, given).tolist()
        pairs = {(label[i], root(i)) for i in range(len(sets))}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_merge_skip():
    rng = random.Random(3)
    for _ in range(300):
        lists = [sorted(rng.sample(range(30), rng.randint(1, 20))) for _ in range(rng.randint(1, 9))]
        often = Counter(x for one in lists for x in one)
        for least in (1, 2, 3, 5):
            assert sorted(jaccard.merge_skip(lists, least)) == sorted((k, v) for k, v in often.items() if v >= least)


def test_shingles(weird):
    texts = [r["text"] or "" for r in weird.collect()]
    for k in (1, 4, 5):
        sets = shingles.shingle_sets(pa.array(texts, pa.string()), k)
        assert [len(s) for s in sets] == [len(shingle_set(t, k)) for t in texts]
        alone = [shingles.shingle_sets(pa.array([t], pa.string()), k)[0] for t in texts]
        assert all((a == b).all() for a, b in zip(sets, alone, strict=True))


def test_jaccard_of_odd_and_no_rows(weird, nothing):
    assert jaccard.link_components(weird).count() == weird.count()
    assert jaccard.link_components(nothing).count() == 0


@pytest.mark.parametrize("few", [0, 10**6])
def test_components(spark, few):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.connected_components(df, "a", "b", few).collect()}
    assert got == {x: root(x) for x in parent}
    assert components.connected_components(df.limit(0), "a", "b", few).count() == 0


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60 + 10 * i) for i in range(6)]
    rows, want = [], {}
    for i in range(120):
        parts = [text(rng.randint(5, 80))]
        if i % 4 == 0:
            p = rng.randrange(len(shared))
            parts += [shared[p], text(rng.randint(1, 40))]
            want.setdefault(p, []).append(i)
        rows.append((i, " ".join(parts)))
    return rows, want


def test_repeated_passages_are_found_and_clean_texts_are_not(spark):
    rows, want = passages(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = chunks.repeated_spans(df).collect()
    later = {i for docs in want.values() for i in docs[1:]}
    assert {r["doc_id"] for r in spans} == later
    texts = dict(rows)
    for r in spans:
        assert texts[r["doc_id"]][r["span_start"] : r["span_end"]].strip() in texts[r["first_doc_id"]]
    left = {r["doc_id"]: r["text"] for r in chunks.remove_spans(df, chunks.repeated_spans(df)).collect()}
    shuffled = chunks.remove_spans(df, chunks.repeated_spans(df), few=-1).collect()
    assert {r["doc_id"]: r["text"] for r in shuffled} == left
    assert len(left) == len(rows) and all(left[i] == t for i, t in rows if i not in later)
    assert all(len(left[i]) < len(texts[i]) for i in later)


def brute_spans(rows, min_chars):
    """Spans from the chunks' texts themselves, document by document."""
    chunked = {}
    for doc, text in rows:
        (sizes,) = chunks.cut_texts(pa.array([text or ""], pa.string()))[2]
        ends = [0, *sizes.cumsum().tolist()]
        n = max(min(1, len(sizes)), len(sizes) - chunks.JOINED + 1)
        parts = [(text or "")[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        chunked[doc] = [(tuple(parts[i : i + chunks.JOINED]), i) for i in range(n)], ends
    first, out = {}, []
    for doc in sorted(chunked):
        for joined, _ in chunked[doc][0]:
            first.setdefault(joined, doc)
    for doc, (joined, ends) in chunked.items():
        seen, run = set(), []
        for t, i in [*joined, (None, 1 << 40)]:
            source = doc if t in seen else first.get(t)
            again = t is not None and (source != doc or t in seen)
            seen.add(t)
            if run and (t is None or again) and i - run[-1][0] > chunks.JOINED:
                end = min(run[-1][0] + chunks.JOINED, len(ends) - 1)
                if ends[end] - ends[run[0][0]] >= min_chars:
                    out.append((doc, ends[run[0][0]], ends[end], end - run[0][0], run[0][1]))
                run = []
            if again:
                run.append((i, source))
    return sorted(out)


@pytest.mark.parametrize("hot", [1_000, 4])
def test_spans_are_those_of_brute_force(spark, monkeypatch, hot):
    """All repeats, by comparing the texts of chunks; with a low bound, chunks of many
    documents take the other way."""
    monkeypatch.setattr(chunks, "HOT", hot)
    monkeypatch.setattr(chunks, "SAMPLED", 2)
    rng = random.Random(21)
    rows = [*passages(7)[0], *((1000 + i, t) for i, t in corpus(5, 150)), (2000, None), (2001, ""), (2002, "again and " * 90)]
    line = " ".join(str(rng.randrange(10**6)) for _ in range(40))
    rows += [(3000 + i, f"{line} {rng.randrange(10**9)} " * rng.randint(1, 2) + line) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r)[:5] for r in chunks.repeated_spans(df, 40).collect())
    assert got == brute_spans(rows, 40) and len(got) > 100


def test_repeats_are_written_before_spans_are_cut(spark, monkeypatch):
    """So the digests' shuffle is gone by then; no table is left behind."""
    paths, write = {}, chunks.written

    def noted(df, name):
        table, paths[name] = write(df, name)
        return table, paths[name]

    monkeypatch.setattr(chunks, "written", noted)
    df = spark.createDataFrame(passages(4)[0], "doc_id long, text string")
    spans = chunks.repeated_spans(df)
    assert "repeats" in paths and spans.count() > 10
    assert "Window" not in str(spans._jdf.queryExecution().optimizedPlan())
    for path in paths.values():
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def test_borders_resist_insertions():
    rng = random.Random(8)
    t = " ".join(str(rng.randrange(10**6)) for _ in range(400))
    a, b = chunks.cut_texts(pa.array([t, "inserted words " + t], pa.string()))[0]
    assert len(set(a.to_pylist()) & set(b.to_pylist())) >= len(a) - 4


def test_chunks_cover_texts(weird):
    texts = [r["text"] or "" for r in weird.collect()] + ["字" * 5_000, "a" * 9_000]
    _, _, sizes = chunks.cut_texts(pa.array(texts, pa.string()))
    assert [int(s.sum()) for s in sizes] == [len(t) for t in texts]
    assert max(int(s.max()) for s in sizes if len(s)) <= chunks.LONGEST + 4


def test_chunks_of_odd_and_no_rows(weird, nothing):
    spans = chunks.repeated_spans(weird)
    assert chunks.remove_spans(weird, spans).count() == weird.count()
    assert chunks.remove_spans(weird, spans).columns == weird.columns
    assert chunks.repeated_spans(nothing).count() == 0


def test_passages_without_white_space_are_found(spark):
    rng = random.Random(12)
    han = lambda n: "".join("。" if i % 20 == 19 else chr(rng.randint(0x4E00, 0x9FA5)) for i in range(n))
    thai = lambda n: "".join(" " if i % 30 == 29 else chr(rng.randint(0xE01, 0xE2E)) for i in range(n))
    rows = []
    for i in range(40):
        text, around = (han if i % 2 else thai), lambda t: t(rng.randint(40, 200))
        shared = text(200)
        rows += [(2 * i + j, around(text) + shared + around(text)) for j in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = chunks.repeated_spans(df).collect()
    assert {(r["doc_id"], r["first_doc_id"]) for r in spans} == {(2 * i + 1, 2 * i) for i in range(40)}
    texts = dict(rows)
    assert all(texts[r["doc_id"]][r["span_start"] : r["span_end"]] in texts[r["first_doc_id"]] for r in spans)


def test_copies_of_texts_of_one_chunk(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("ABCDEFGHijklmnop0123456789+/") for _ in range(110))
    single = []
    while len(single) < 12:
        t = word()
        if len(chunks.cut_texts(pa.array([t], pa.string()))[2][0]) == 1:
            single.append(t)
    rows = [(i, t) for i, t in enumerate(single * 3 + [word() for _ in range(40)])]
    for _ in range(3):
        rng.shuffle(rows)
        got = chunks.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
        want = {(i, 0, 110, i % 12) for i in range(12, 36)}
        assert {(r["doc_id"], r["span_start"], r["span_end"], r["first_doc_id"]) for r in got} == want


def test_chunks_do_not_depend_on_the_texts_around():
    rng = random.Random(15)
    texts = ["", "a", "x" * 90, "abc " * 50] + ["".join(rng.choice("ab c字") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    for t, d, low, n in zip(texts, *chunks.cut_texts(pa.array(texts, pa.string())), strict=True):
        (alone,), (other,), (size,) = chunks.cut_texts(pa.array([t], pa.string()))
        assert d.to_pylist() == alone.to_pylist() and low.tolist() == other.tolist() and n.tolist() == size.tolist()


@pytest.mark.parametrize("name", [None, 5])
def test_texts_of_one_doc_id_are_apart(spark, name):
    rng = random.Random(16)
    text = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    twice, shared, clean = text(60), text(60), text(300)
    rows = [
        (name, f"{twice} {text(9)} {twice} {text(9)}"), (name, clean), (name, clean),
        (name, f"{text(30)} {shared} {text(30)}"), (name, f"{text(20)} {shared} {text(50)}"), (8, f"{text(20)} {shared}"), (9, text(90)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = chunks.repeated_spans(df).collect()
    assert sorted((r["doc_id"] or 0, r["first_doc_id"]) for r in spans) == [(name or 0, name)] * 2 + [(8, name)]
    for few in (-1, 10**6):
        left = [r["text"] for r in chunks.remove_spans(df, chunks.repeated_spans(df), few=few).collect()]
        assert len(left) == len(rows) and left.count(clean) == 2 and rows[-1][1] in left
        words = " ".join(left).split()
        assert all(words.count(w) == 1 for w in shared.split()[15:40] + twice.split()[15:40])
