import hashlib
import time
import zlib

import numpy as np
import pytest
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from riskfold.llm import periodic_runs as P


def brute(words, min_words=24, min_exponent=3):
    """All maximal stretches of period q, for every q, that no divisor of q is a period of."""
    x, found = np.array(words), []
    for q in range(1, len(x) // min_exponent + 1):
        same = np.concatenate(([0], (x[q:] == x[:-q]).astype(np.int8), [0]))
        first, last = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for a, b in zip(first.tolist(), last.tolist()):
            n = b - a + q
            if n >= max(min_words, min_exponent * q) and all(q % d or not (x[a:a + n - d] == x[a + d:a + n]).all() for d in range(1, q)):
                found.append((a, n, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def naive_order(symbols):
    s = [int(x) + 1 for x in symbols] + [0]
    return sorted(range(len(s)), key=lambda i: s[i:]), s


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_tree(symbols):
    tree = P.SuffixTree(np.array(symbols, dtype=np.int64))
    order, s = naive_order(symbols)
    assert np.argsort(tree.rank).tolist() == order
    i, j = np.array([(a, b) for a in range(len(s)) for b in range(len(s)) if a != b], dtype=np.int64).reshape(-1, 2).T
    common = lambda a, b: next((k for k in range(len(s)) if s[a + k] != s[b + k]), 0)
    assert tree.extension(i, j).tolist() == [common(a, b) for a, b in zip(i.tolist(), j.tolist())]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([(2, 2), (6, 3), (4, 2), (10, 3)]))
def test_runs_of_short_sequences(symbols, least):
    got = [tuple(r) for r in P.runs_of(np.array(symbols, dtype=np.int64), *least)]
    assert got == brute(symbols, *least)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 4), min_size=1, max_size=9), st.integers(1, 9)), max_size=8))
def test_whole_texts(parts):
    words = [b"w%d" % x for body, times in parts for x in body * times]
    hashes = np.array([zlib.crc32(w) for w in words], dtype=np.uint64)
    assert P._find(words, hashes, 24, 3) == brute(words)


def _collapse(words, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def expected(key, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    h = zlib.crc32(str(key).encode())
    if key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    number = {}
    runs = brute([number.setdefault(w, len(number)) for w in words])
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    best = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(_collapse(words, runs)))


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
           for r in P.op11_periodic_runs(spark, SF_SMALL).collect()}
    assert len(got) == len(rows) and any(v[0] for v in got.values())
    for r in rows:
        assert got[r.doc_id] == expected(r.doc_id, r.text), r.doc_id


def test_odd_rows(spark):
    line = "all rights reserved now "
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, line * 10), (4, line * 10), (4, line * 10), (5, "x " * 24), (6, "x " * 23),
            (7, "lead " + "α β γ " * 12 + "α tail"), (8, "  " * 30)]
    docs = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id long, runs int")
    got = {(r.doc_id, r.n_words): ([tuple(x) for x in r.runs], r.collapsed) for r in P.periodic_runs(docs).collect()}
    assert got == {(1, 0): ([], ""), (2, 0): ([], ""), (3, 0): ([], ""), (None, 40): ([(0, 40, 4)], line.strip()),
                   (4, 40): ([(0, 40, 4)], line.strip()), (5, 24): ([(0, 24, 1)], "x"), (6, 23): ([], " ".join("x" * 23)),
                   (7, 39): ([(1, 37, 3)], "lead α β γ tail"), (8, 30): ([(0, 30, 1)], " ")}
    assert P.periodic_runs(docs.where("false")).collect() == []


@pytest.mark.parametrize("words", [["a"] * 60_000, ["a", "b"] * 30_000, [f"w{k % 9973}" for k in range(60_000)]])
def test_long_texts_stay_linear(words):
    raw = [w.encode() for w in words]
    hashes = np.array([zlib.crc32(w) for w in raw], dtype=np.uint64)
    start = time.time()
    found = P._find(raw, hashes, 24, 3)
    assert found == [(0, 60_000, len(set(words)))]
    assert time.time() - start < 10
