"""Greedy clusters in waves and bounded pairs against brute force."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from riskfold.operators import news, vector_index, vectors
from test_vectors_news import QUALITY, _sequential_greedy


@pytest.mark.parametrize("kind", ["array<float>", "array<double>"])
def test_clusters_in_waves_match_sequential(spark, monkeypatch, kind):
    monkeypatch.setattr(vectors, "FIRST_WAVE", 20, raising=False)
    rng = np.random.default_rng(17)
    n = 300
    vecs = rng.normal(size=(9, 16))[rng.integers(0, 9, n)] + 0.6 * rng.normal(size=(n, 16))
    vecs = (vecs / np.linalg.norm(vecs, axis=1, keepdims=True)).astype("float32").astype("float64")
    groups = ["hot" if i % 5 else f"g{i % 3}" for i in range(n)]  # the small ones stay in the first wave
    summaries = ["x" * int(k) for k in rng.integers(1, 50, n)]
    QUALITY.clear()
    QUALITY.update({i: len(summaries[i]) for i in range(n)})
    ids = [f"{i:04d}" for i in range(n)]
    rows = [(ids[i], groups[i], [float(x) for x in vecs[i]], "", summaries[i]) for i in range(n)]
    df = spark.createDataFrame(rows + [("null", "hot", None, "", "x"), (None, "hot", rows[0][2], "", "x")],
                               f"id string, ticker string, vec {kind}, headline string, summary string")
    got = {r.id for r in vectors.dedupe_similar(df, 0.8, tile_size=16).collect()}
    assert got - {None} == _sequential_greedy(ids, vecs, groups, 0.8) and len(got) > 60


def test_an_id_in_two_groups_is_decided_once(spark, monkeypatch):
    rng = np.random.default_rng(37)
    vecs = rng.normal(size=(5, 8))[rng.integers(0, 5, 120)] + 0.5 * rng.normal(size=(120, 8))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, "t", [float(x) for x in vecs[i]], "", "s" * (1 + i % 11)) for i in range(120)],
                               "id long, ticker string, vec array<double>, headline string, summary string")
    twice = df.unionByName(df.where("id < 70 and id % 3 > 0").withColumn("ticker", F.lit("other")))
    monkeypatch.setattr(vectors, "FIRST_WAVE", 20, raising=False)
    waves = {tuple(r) for r in vectors.dedupe_similar(twice, 0.8, tile_size=16).collect()}
    monkeypatch.setattr(vectors, "FIRST_WAVE", 10 ** 6, raising=False)
    assert waves == {tuple(r) for r in vectors.dedupe_similar(twice, 0.8, tile_size=16).collect()}


def test_near_copies_make_few_edges(spark, monkeypatch):
    """The edges of n near copies do not grow with n * n."""
    monkeypatch.setattr(vectors, "FIRST_WAVE", 40, raising=False)
    made, whole = [], vectors.greedy_clusters
    monkeypatch.setattr(vectors, "greedy_clusters", lambda edges: made.append(edges.count()) or whole(edges))
    rng = np.random.default_rng(19)
    vecs = np.ones((900, 8)) + 0.05 * rng.normal(size=(900, 8))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, "t", [float(x) for x in vecs[i]], "", "s" * (1 + i % 7)) for i in range(900)],
                               "id long, ticker string, vec array<double>, headline string, summary string")
    gone = {r.id: r.anchor for r in vectors.dedupe_similar(df, 0.9, tile_size=64).collect()}
    assert set(gone) == set(range(900)) - {6} and set(gone.values()) == {0}
    assert sum(made) < 900 * 900 / 2 / 10


def test_pairs_of_a_tile_full_of_near_copies(spark):
    x = (np.ones((300, 8)) + 0.05 * np.random.default_rng(23).normal(size=(300, 8))).astype("float32")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, "t", [float(v) for v in x[i]]) for i in range(300)], "id long, ticker string, vec array<float>")
    exact = x.astype("float64") @ x.astype("float64").T
    threshold = float(np.median(exact))  # many pairs next to it: decided in double precision
    got = {(r.a, r.b): r.sim for r in vector_index.similar_pairs(df, threshold, tile_size=2048).collect()}
    assert set(got) == {(i, j) for j in range(300) for i in range(j) if exact[i, j] >= threshold} and len(got) > 2 * vector_index.PAIR_ROWS
    assert max(abs(s - exact[p]) for p, s in got.items()) < 1e-12


def test_earliest_similar_anchor(spark):
    rng = np.random.default_rng(29)
    x = rng.normal(size=(260, 6))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("float32")
    df = spark.createDataFrame([(f"k{i}", "t" if i % 3 else "u", i * 7 % 263, [float(v) for v in x[i]]) for i in range(260)],
                               "id string, ticker string, o long, vec array<float>")
    early, late = df.where("o < 100"), df.where("o >= 100")
    exact = x.astype("float64") @ x.astype("float64").T
    for tile in (8, 1000):
        got = {r.id: r.anchor for r in vector_index.earliest_similar(late, early, 0.8, order="o", tile_size=tile).collect()}
        want = {}
        for i in (i for i in range(260) if i * 7 % 263 >= 100):
            near = [j for j in range(260) if j * 7 % 263 < 100 and (i % 3 == 0) == (j % 3 == 0) and exact[i, j] >= 0.8]
            if near:
                want[f"k{i}"] = f"k{min(near, key=lambda j: j * 7 % 263)}"
        assert got == want and want
    assert vector_index.earliest_similar(late, early.where("false"), 0.8, order="o").collect() == []


def test_stored_index_is_the_bytes_of_the_index(spark):
    rng = np.random.default_rng(31)
    rows = [(f"k{i}", "t" if i % 3 else None, [float(x) for x in rng.normal(size=vectors.DIM_TEXT).astype("float32")]) for i in range(30)]
    encoded = (spark.createDataFrame(rows, "id string, ticker string, vec array<float>")
               .withColumn("pubdate", F.when(F.col("id") != "k7", F.lit("2024-02-20 10:00:00").cast("timestamp_ntz"))))
    want = vectors.build_index(encoded, "2024-03-02 00:00:00").select("id", vectors.vector_to_bytes(F.col("ivect")).alias("ivect"))
    got = vectors.stored_index(encoded, "2024-03-02 00:00:00")
    assert got.schema == want.schema and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_preview_cuts_texts_before_the_join(spark):
    arts = spark.createDataFrame([(f"k{i}", "t", "h" * 90, "s" * 300, f"2024-02-{10 + i}") for i in range(12)],
                                 "id string, ticker string, headline string, summary string, day string")
    arts = arts.select("id", "ticker", "headline", "summary", F.col("day").cast("timestamp_ntz").alias("pubdate"))
    index = arts.where("id <> 'k11'").select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("ivect"))
    got = news.preview(arts, index, limit=3)
    assert [tuple(r)[:4] + (r.ivect_bytes,) for r in got.collect()] == [(f"k{i}", "t", "h" * 60, "s" * 80, 8) for i in (10, 9, 8)]
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.index("Join") < plan.index("substring(summary")


def test_sample_holds_the_rows_of_least_hash(spark):
    df = spark.range(500).select("id", F.array(F.col("id").cast("double")).alias("vec"))
    df = df.withColumn("vec", F.when(F.col("id") % 5 > 0, F.col("vec")))
    want = [r.id for r in df.where("vec is not null").orderBy(F.xxhash64("id")).limit(3 * vector_index.SAMPLE_PER_PIVOT).collect()]
    assert vector_index._sample(df, "id", "vec", 3, False)[:, 0].tolist() == want
    assert vector_index._sample(df.where("false"), "id", "vec", 3, False).tolist() == [[0.0]]
