"""Encoders, counts and packing against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm import bpe, counts, packing, vocab

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encode_decode_and_count(spark, weird, path):
    lib = Tokenizer.from_file(path)
    got = bpe.encode(weird, path, ["doc_id", "lang"], decoded=True)
    rows = bpe.decode(got, path, out="again")
    texts = [r["text"] or "" for r in weird.collect()]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    for r, t, ids in zip(rows.collect(), texts, want, strict=True):
        assert r["ids"] == ids, t[:40]
        assert r["decoded"] == r["again"] == lib.decode(ids, skip_special_tokens=False)
    counted = counts.count_tokens(weird, path, ["doc_id"]).collect()
    assert [r["n_tokens"] for r in counted] == list(map(len, want))
    assert [r["n_bytes"] for r in counted] == [len(t.encode()) for t in texts]


def test_random_words_agree():
    rng = random.Random(1)
    for path in (WORD, BYTE):
        lib, own, n = Tokenizer.from_file(path), bpe.encoder(path), counts.counter(path)
        for _ in range(1500):
            t = "".join(rng.choice("aabbcdeth .,'!é北9\n") for _ in range(rng.randint(1, 40)))
            ids = lib.encode(t, add_special_tokens=False).ids
            assert own.encode(t) == ids and n.count(t) == len(ids), t


def test_new_code_points_and_long_runs_agree():
    """Characters that Unicode tables of different ages call differently, in short
    texts and in texts that go to the other encoder for a long run."""
    import unicodedata

    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    new = [i for i in points if unicodedata.category(chr(i)) == "Cn" and i < 0x33480]
    some = new[::7] + [i for i in points if unicodedata.category(chr(i)) != "Cn"][::211] + [0x1E6C0]
    texts = [f"a{chr(i)}b{chr(i)}'s" for i in some]
    texts += ["\U0001e6c0's " * 3 + "x" * 1500 + " and " * 900, "é's " * 3 + "x" * 1500 + " and " * 900, " " * 1200 + "end", "y" * 999 + " z"]
    for path in (WORD, BYTE):
        lib, count = Tokenizer.from_file(path), counts.counter(path).count
        encode = packing.token_arrays(path, 1) if path == BYTE else None
        for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
            assert count(t) == len(e.ids), t[:20]
            assert encode is None or encode(t).tolist() == [*e.ids, 1], t[:20]


def test_cache_is_bounded():
    cache = vocab.WordCache(len, 10)
    for i in range(100):
        assert cache["x" * i] == i and len(cache) <= 10


def check_pieces(rows, ids, window=2048):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda r: r["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[doc])
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[doc][at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids[doc])
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_pack(spark, weird):
    lib = Tokenizer.from_file(BYTE)
    rows = weird.where("doc_id is not null").dropDuplicates(["doc_id"]).coalesce(2)
    ids = {r["doc_id"]: lib.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in rows.collect()}
    got = packing.pack(rows, BYTE, with_ids=True)
    assert check_pieces(got.collect(), ids) == 0
    assert all(r["ids"] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]] for r in got.collect())
    assert packing.pack(weird, BYTE).agg(F.sum("length")).first()[0] == sum(
        len(lib.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in weird.collect()
    )


@pytest.mark.parametrize("max_open", [1, 3, 4096])
@pytest.mark.parametrize("sizes", [[1100] * 50, list(range(1, 300, 7)), [2048, 4096, 5000, 1, 2047], [1] * 40])
def test_packer(sizes, max_open):
    out = []
    packer = packing.Packer(lambda pieces: out.append(pieces), 2048, max_open)
    ids = {d: np.arange(n, dtype="<u4") + d for d, n in enumerate(sizes)}
    for d, x in ids.items():
        packer.add(d, x)
        assert packer.n_open <= max_open and packer.n_open == packer.counts.sum()
    packer.finish()
    rows = [
        {"doc_id": d, "start": s, "length": len(x), "doc_tokens": n, "sequence_id": q, "offset": sum(len(p[2]) for p in pieces[:k]), "ids_crc32": zlib.crc32(x.tobytes())}
        for q, pieces in enumerate(out) for k, (d, s, x, n) in enumerate(pieces)
    ]
    assert check_pieces(rows, ids) == 0


def test_rule_minimises_squares():
    packer = packing.Packer(lambda pieces: None, 10)
    packer.counts[4], packer.open[4], packer.n_open = 2, [[(0, 0, np.zeros(4), 4)], [(1, 0, np.zeros(4), 4)]], 2
    packer.add(2, np.zeros(3, "<u4"))  # two windows at 4 cost 4; one at 4 and one at 7 cost 2
    assert packer.counts[4] == 1 and packer.counts[7] == 1


def test_empty(nothing):
    assert bpe.encode(nothing, BYTE, ["doc_id"]).count() == 0
    assert counts.count_tokens(nothing, BYTE, ["doc_id"]).count() == 0
    assert packing.pack(nothing, BYTE).count() == 0
