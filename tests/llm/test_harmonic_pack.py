import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF_SMALL

from riskfold.llm import harmonic_pack as H


def check_pieces(rows, expect, capacity):
    """rows: dicts of pieces; expect: multiset of (doc_id, ids with the end id)."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) // 4 > 0
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    assert by_doc.keys() == {i for i, _ in expect}
    ids_of = defaultdict(list)
    for i, ids in expect:
        ids_of[i].append(ids)
    for i, ps in by_doc.items():
        if len(ids_of[i]) == 1:
            ps.sort(key=lambda p: p["start"])
            assert [p["start"] for p in ps] == np.cumsum([0] + [p["length"] for p in ps])[:-1].tolist()
            assert {p["doc_tokens"] for p in ps} == {len(ids_of[i][0])}
            assert b"".join(p["ids"] for p in ps) == np.array(ids_of[i][0], dtype="<u4").tobytes()
        else:  # repeated rows: the tokens of all of them
            assert sum(p["length"] for p in ps) == sum(map(len, ids_of[i]))
    return by_sequence


def padding(by_sequence, capacity):
    used = [sum(p["length"] for p in ps) for ps in by_sequence.values()]
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in used)


def tokens_of(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(H.default_tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids + [H.END_ID] for x in texts]


@pytest.mark.parametrize("length", [1, 2, 255, 256, 257, 1365, 1366, 2047, 2048, 2049, 4095, 4096, 4097, 8192, 9999])
def test_classes(length):
    parts = H.classes_of(length)
    assert sum(n for _, n in parts) == length
    for k, n in parts:
        assert k == H.CAPACITY // n and (k >= H.FINE or H.CAPACITY - k * n < k)


def test_words_encode_like_whole_texts():
    rng = random.Random(3)
    parts = ["word", "don't", "I'll", "x'S", " ", "  ", "\n", "\t", " ", "\x1c", "\x85", " ", "​", "é", "é", "́", "Σ", "ΣΑΣ",
             "İ", "12", "½", "漢字", "ไทย", "😀", "<|endoftext|>", "<|", "...", "--", "﻿", "­", "ﬁ", "한", "ᄒ", "ᅡ", "A", ".", ",", "'", "$", "&&", "É", "ß", "ÑÍ", "ſ", "ı", "ŉ", "ÿŸ", "×", "it's", "a1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(12000)] + ["", "a" * 5000]
    coder = H.WordIds(H.default_tokenizer())
    assert coder.local
    for t, ids in zip(texts, tokens_of(texts)):
        assert np.frombuffer(coder.encode(t), dtype="<u4").tolist() == ids[:-1], repr(t)


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(H, "CACHE_BYTES", 2000)
    coder = H.WordIds(H.default_tokenizer())
    texts = [f"word{i} common other{i % 5}" for i in range(200)]
    assert [np.frombuffer(coder.encode(t), dtype="<u4").tolist() for t in texts] == [ids[:-1] for ids in tokens_of(texts)]


def test_query(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(3, "doc_id")
    expect = list(zip([r.doc_id for r in rows], tokens_of([r.text for r in rows])))
    pieces = [r.asDict() for r in H.pack(docs, H.default_tokenizer()).collect()]
    by_sequence = check_pieces(pieces, expect, H.CAPACITY)
    assert padding(by_sequence, H.CAPACITY) < 0.03 * sum(len(ids) for _, ids in expect)
    total = {r.doc_id: 0 for r in rows}
    for r in H.op12_harmonic_pack(spark, SF_SMALL).collect():
        ids = np.array(dict(expect)[r.doc_id], dtype="<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
        total[r.doc_id] += r.length
    assert total == {i: len(ids) for i, ids in expect}


def test_many_workers_and_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(400)))) for i in range(900)]
    rows += [(5, "same text")] * 300 + [(None, "no id"), (901, None), (902, ""), (903, "long " * 9000)]
    docs = spark.createDataFrame([(t, i, i) for i, t in rows], "text string, doc_id long, class long").repartition(9)
    pieces = [r.asDict() for r in H.pack(docs, H.default_tokenizer()).collect()]
    by_sequence = check_pieces(pieces, list(zip([i for i, _ in rows], tokens_of([t for _, t in rows]))), H.CAPACITY)
    steps = {s // H.STEP for s in by_sequence}
    assert steps == {1, 2, 3}
    # leftovers of all workers: at most one unfilled sequence per power of two in the last step
    last = [sum(p["length"] for p in ps) for s, ps in by_sequence.items() if s // H.STEP == 3]
    assert all(n & (n - 1) == 0 for n in last)
    # class k bins hold k pieces
    for s, ps in by_sequence.items():
        if s // H.STEP < 3:
            assert {H.CAPACITY // p["length"] for p in ps} == {len(ps)}


def test_sequences_and_small_capacity(spark, tmp_path):
    docs = spark.createDataFrame([(i, "one two three four five " * (i % 4)) for i in range(60)], "doc_id long, text string").repartition(4)
    pieces = H.pack(docs, H.default_tokenizer(), path=str(tmp_path / "pieces"), capacity=32, fine=4)
    check_pieces([r.asDict() for r in pieces.collect()], list(zip(range(60), tokens_of(["one two three four five " * (i % 4) for i in range(60)]))), 32)
    by_sequence = defaultdict(dict)
    for r in pieces.collect():
        by_sequence[r.sequence_id][r.offset] = r.ids
    for r in H.sequences(pieces, pad_id=9, capacity=32).collect():
        ids = b"".join(v for _, v in sorted(by_sequence[r.sequence_id].items()))
        n = len(ids) // 4
        assert r.n_tokens == n
        assert bytes(r.ids) == ids + np.full(0 if n & (n - 1) == 0 else 32 - n, 9, dtype="<u4").tobytes()


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert H.pack(docs, H.default_tokenizer()).collect() == []
