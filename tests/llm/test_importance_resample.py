import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from conftest import SF_SMALL

from riskfold.llm import importance_resample as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, ngram=1):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i:i + n]) for n in range(1, ngram + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, ngram=1):
    """{position: (n_features, weight, score, rank)} with ties to the smaller id."""
    s, t = [0] * R.BUCKETS, [0] * R.BUCKETS
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            for f in grams(x, ngram)[1]:
                counts[zlib.crc32(f.encode()) % R.BUCKETS] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + R.BUCKETS) / ((a + 1) * (sum(t) + R.BUCKETS)))) for a, b in zip(s, t)]
    out, can = {}, []
    for at, (i, x) in enumerate(rows):
        words, fs = grams(x, ngram)
        weight = sum(gain[zlib.crc32(f.encode()) % R.BUCKETS] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[at] = [len(fs), weight, score, None]
        if len(words) >= R.MIN_WORDS:
            can.append((-score, i is None, i, at))
    for rank, (*_, at) in enumerate(sorted(can)[:10 * len(can) // 100], 1):
        out[at][3] = rank
    return out


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    expect = brute(rows, target)
    got = {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in R.op13_importance_resample(spark, SF_SMALL).collect()}
    assert len(got) == len(rows)
    assert got == {rows[at][0]: v for at, v in expect.items()}


@pytest.mark.parametrize("ngram", [1, 2, 3])
def test_features(ngram):
    texts = ["One two, THREE four", "", "É été-x 42 " + "y" * 200 + " z", "\x00 ..", "a b", "a"]
    bucket, row, words = R.features(texts, ngram)
    for i, t in enumerate(texts):
        w, fs = grams(t, ngram)
        assert words[i] == len(w)
        assert sorted(bucket[row == i]) == sorted(zlib.crc32(f.encode()) % R.BUCKETS for f in fs)


def _many(n=600):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary, 25 + i % 7))) for i in range(n)]
    same = " ".join(vocabulary[:30])
    # a third is one repeated row; null ids, null, empty, short and odd texts
    return rows + [(7, same)] * (n // 2) + [(None, same), (None, None), (n, None), (n + 1, ""), (n + 2, "too short")], [same, None, "w1 w2"]


def test_ties_nulls_and_repeated_rows(spark):
    rows, target = _many()
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, rank long").repartition(7)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    drawn = R.ranked(R.score(docs.withColumnRenamed("rank", "score"), bench)).collect()
    expect = brute(rows, target)
    key = lambda v: tuple(-1 if x is None else x for x in v)
    assert sorted(key((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in drawn) == \
        sorted(key((rows[at][0], *v)) for at, v in expect.items())
    assert all(r.text == rows[0][1] for r in drawn if r.doc_id == 0)


def test_same_ranks_however_the_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(R, "RUN_SAMPLES", 5)
    monkeypatch.setattr(R, "GROUP_SAMPLES", 7)
    monkeypatch.setattr(R, "LEAST_SEGMENTS", 13)
    rows, target = _many(300)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    expect = sorted((v[3], rows[at][0]) for at, v in brute(rows, target).items() if v[3])
    for parts in (1, 3, 40):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = R.resample(docs, bench).collect()
        assert sorted((r["rank"], r.doc_id) for r in got) == expect


def test_small_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    got = R.ranked(R.score(docs, none)).collect()
    assert {(r.doc_id, r.n_features, r.weight, r["rank"]) for r in got} == \
        {(i, f, w, None) for i, f, w in [(1, 2, brute([(1, "a b"), (2, None)], [])[0][1]), (2, 0, 0)]}
    assert R.ranked(R.score(docs.where("false"), none)).collect() == []


def test_splitters_stay_balanced(spark):
    keys = spark.range(20_000).select(*[(F_col * 7919 % 20_011).alias(k) for F_col, k in [(_id(), R.KEY[0])]],
                                      _id().alias("__id"), _id().alias("row_hash"),
                                      _run().alias("__run"), _id().alias("__at")).repartition(8, "__id")
    cuts = R._splitters(R._samples(keys.withColumn("__run", _run())), 16)
    scores = np.array([r[0] for r in keys.select(R.KEY[0]).collect()])
    sizes = np.diff(np.concatenate(([0], np.searchsorted(np.sort(scores), [c[0] for c in cuts]), [len(scores)])))
    assert len(cuts) == 15 and sizes.max() < 2 * len(scores) / 16


def _id():
    from pyspark.sql import functions as F
    return F.col("id")


def _run():
    from pyspark.sql import functions as F
    return F.spark_partition_id()
