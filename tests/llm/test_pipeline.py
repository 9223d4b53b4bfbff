"""The stages one after another on planted rows."""

import random

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    english, german = ("the and of to in that was for with they".split(), "der die und das von nicht mit sich ist ein".split())
    make = lambda n, small: " ".join(rng.choice(small) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows = [(i, make(60, german if i % 2 else english), "de" if i % 2 else "en", "s", 0) for i in range(80)]
    passage = make(70, english)
    near = rows[4][1].split()
    near[30] = "changed"
    rows += [
        (100, rows[4][1], "en", "s", 0), (101, " ".join(near), "en", "s", 0), (102, "12 34 !!", None, None, None), (103, None, "en", "s", 0),
        (104, make(50, english) + " password=hunter2222 " + make(5, english), "en", "s", 0),
        (105, make(40, english) + " " + passage, "en", "s", 0), (106, make(90, english) + " " + passage + " " + make(20, english), "en", "s", 0),
        (5, rows[5][1], "de", "s", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == COLUMNS
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    everything = {r[0]: r[1] for r in rows}
    assert set(seen["language"]) == set(everything) - {102, 103}
    assert set(seen["near_duplicates"]) == set(everything) - {100, 101, 102, 103}
    assert docs.where("doc_id = 5").count() == 1
    cut = {i for i, t in seen["repeated_spans"].items() if t != everything[i]}
    assert cut == {106} and len(seen["repeated_spans"][106]) < len(everything[106]) - 250
    assert {i for i, t in seen["secrets"].items() if t != seen["repeated_spans"][i]} == {104}
    assert "hunter" not in seen["secrets"][104] and "<SECRET>" in seen["secrets"][104]
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    packed = corpus_pipeline.pack(spark, docs, "").collect()
    assert {r["doc_id"] for r in packed} == set(seen["secrets"])


def test_null_and_repeated_identifiers_and_clashing_columns(spark, tmp_path):
    """No character goes but those of true copies and repeats, whatever the doc_ids and
    the names of other columns."""
    rng = random.Random(6)
    english = "the and of to in that was for with they".split()
    make = lambda n: " ".join(rng.choice(english) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    texts = {name: make(90) for name in "abcdefgh"}
    passage = make(70)
    near = texts["c"].split()
    near[40] = "changed"
    rows = [
        (None, texts["a"]), (None, texts["b"]), (7, texts["d"]), (3, texts["c"]), (7, " ".join(near)), (None, texts["c"]),
        (5, texts["e"]), (5, f"{make(20)} {passage} {make(20)}"), (6, f"{make(30)} {passage}"), (None, f"{passage} {texts['f']}"),
        (5, texts["e"]), (None, texts["b"]), (None, None), (8, texts["g"] + " token=abcdef99 " + texts["h"]),
    ]
    extra = ["score", "lang_pred", "spans", "__text", "__cuts", "__row", "text_hash", "component", "ids"]
    rows = [(*r, "en", "s", 0, *[f"{c}{i}" for c in extra]) for i, r in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    docs, seen = spark.createDataFrame(rows, schema).repartition(3), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        seen[name] = docs.collect()
    assert sorted(r["__text"] for r in seen["language"]) == sorted(f"__text{i}" for i in range(14) if i != 12)
    kept = [(r["doc_id"], r["text"]) for r in seen["near_duplicates"]]
    want = {(r[0], r[1]) for r in rows if r[1]} - {(7, " ".join(near)), (None, texts["c"])}
    assert len(kept) == len(want) and set(kept) == want
    left = " ".join(r["text"] for r in seen["repeated_spans"]).split()
    assert left.count("token=abcdef99") == 1
    whole = [r["text"] for r in seen["repeated_spans"]]
    assert all(texts[name] in whole for name in "abcde") and any(texts["f"] in t for t in whole)
    words = passage.split()
    joined = " ".join(whole)
    middle = " ".join(words[15:55])
    assert joined.count(middle) == 1
    masked = [r["text"] for r in seen["secrets"] if r["doc_id"] == 8]
    assert len(masked) == 1 and "abcdef99" not in masked[0] and texts["h"] in masked[0]
    assert {r["doc_id"] for r in corpus_pipeline.pack(spark, docs, "").collect()} == {None, 3, 5, 6, 7, 8}


def test_identifiers_of_text(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", "the and of to in that was for with they " * 3 + str(i) * 9, "en", "s", 0) for i in range(12)],
                                 "doc_id string, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0
    assert corpus_pipeline.pack(spark, docs, "").count() > 0


def test_run_and_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
