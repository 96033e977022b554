"""Stored index and pruned pairs against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskfold.operators import maintenance, vector_index as V, vectors
from riskfold.sources.versioned import VersionedStore


def clustered(n, dim, groups, spread, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, tickers=3):
    return spark.createDataFrame([(i, f"t{i % tickers}", [float(v) for v in x[i]]) for i in range(len(x))],
                                 "id long, ticker string, vec array<double>").repartition(5)


def questions(spark, q, only):
    return spark.createDataFrame([(f"q{j}", [float(v) for v in q[j]], only(j)) for j in range(len(q))],
                                 "qid string, qvec array<double>, qticker string")


def full_sort(x, q, k, allowed):
    s = np.round((x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)) @ q, V.DIGITS)
    ids = [i for i in range(len(x)) if allowed(i)]
    return sorted(((-s[i], i) for i in ids))[:k]


@pytest.mark.parametrize("spread", [0.1, 5.0])
def test_search_equals_full_sort(spark, monkeypatch, spread):
    monkeypatch.setattr(V, "PART_ROWS", 40)
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    x = clustered(700, 12, 15, spread, 1)
    x[5:60] = x[5]          # many equal rows: ties go to the smaller id
    x[100] = 0              # a zero vector scores zero
    q = clustered(8, 12, 4, 1.0, 2) * 1.7
    q[3] = x[5]
    only = lambda j: [None, "t1", "none such"][j % 3]
    index = V.build(frame(spark, x), vec="vec", cells=20)
    for found in (V.search(index, questions(spark, q, only), 7), V.search(V.open_index(spark, index.path), questions(spark, q, only), 7),
                  V.scan(frame(spark, x), questions(spark, q, only), 7)):
        got = {}
        for r in found.collect():
            got.setdefault(r.qid, []).append((r["rank"], r.id, r.score))
        for j in range(len(q)):
            want = full_sort(x, q[j], 7, lambda i: only(j) is None or f"t{i % 3}" == only(j))
            assert [(i, pytest.approx(-s, abs=2e-6)) for s, i in want] == [(i, s) for _, i, s in sorted(got.get(f"q{j}", []))]


def test_search_reads_few_cells_of_clustered_vectors(spark):
    x = clustered(3000, 16, 40, 0.05, 3)
    index = V.build(frame(spark, x), vec="vec", cells=60)
    ask = questions(spark, x[:20], lambda j: None)
    assert V.visited_share(index, ask, 5) < 0.15
    flat = V.build(frame(spark, clustered(1000, 64, 1000, 1, 4)), vec="vec", cells=20)
    assert V.visited_share(flat, questions(spark, clustered(3, 64, 3, 1, 5), lambda j: None), 5) <= 1


def test_search_without_rows_or_queries(spark):
    none = frame(spark, np.zeros((1, 4))).where("false")
    ask = questions(spark, np.ones((2, 4)), lambda j: None)
    assert V.search(V.build(none, vec="vec"), ask).collect() == [] == V.scan(none, ask).collect()
    index = V.build(frame(spark, clustered(30, 4, 3, 1, 1)).withColumn("vec", F.when(F.col("id") != 3, F.col("vec"))), vec="vec")
    assert V.search(index, ask.where("false")).collect() == []
    assert index.rows().count() == 29  # a row without a vector is not indexed


@pytest.mark.parametrize("spread,threshold,tile", [(0.2, 0.9, 30), (3.0, 0.4, 30), (0.5, 0.8, 1000), (0.3, -0.5, 25)])
def test_pairs_equal_brute_force(spark, spread, threshold, tile):
    x = clustered(400, 8, 12, spread, 7) * np.linspace(0.7, 1.3, 400)[:, None]  # not only unit vectors
    x[50:90] = x[50]
    x[3] = 0
    group = ["hot" if i % 4 else f"g{i % 3}" for i in range(400)]
    df = spark.createDataFrame([(f"k{i}", group[i], i * 7 % 401, [float(v) for v in x[i]]) for i in range(400)],
                               "id string, ticker string, o long, vec array<double>")
    got = sorted((r.group, r.a, r.b) for r in V.similar_pairs(df, threshold, order="o", tile_size=tile).collect())
    want = sorted((group[i], *(f"k{k}" for k in sorted((i, j), key=lambda k: k * 7 % 401))) for i in range(400) for j in range(i)
                  if group[i] == group[j] and x[i] @ x[j] >= threshold)
    assert got == want and want


def test_pairs_of_clustered_vectors_compare_little(spark):
    x = clustered(3000, 16, 60, 0.03, 9)
    assert V.compared_share(frame(spark, x, tickers=1), 0.9, tile_size=100) < 0.1
    assert V.compared_share(frame(spark, x, tickers=1), 0.9, tile_size=4000) == 1.0


def test_encoder_keeps_every_row(spark):
    df = spark.createDataFrame([(1, "Alpha beta ALPHA"), (1, "gamma"), (2, None), (3, " .,! ")], "id long, text string")
    got = sorted((r.id, r.n_tokens, r.n_buckets, round(sum(v * v for v in r.vec), 5)) for r in vectors.hash_encode(df).collect())
    assert got == [(1, 1, 1, 1.0), (1, 3, 2, 1.0), (2, 0, 0, 0.0), (3, 0, 0, 0.0)]


def test_bytes_round_trip_with_nulls(spark):
    df = spark.createDataFrame([(1, [1.5, -2.0]), (2, None), (3, [])], "id long, v array<float>").coalesce(1)
    data = df.select("id", "v", vectors.vector_to_bytes(F.col("v")).alias("b"))
    got = {r.id: (r.v, r.b, r.w) for r in data.withColumn("w", vectors.bytes_to_vector(F.col("b"))).collect()}
    assert got[1] == ([1.5, -2.0], np.array([1.5, -2.0], "<f4").tobytes(), [1.5, -2.0]) and got[2] == (None, None, None) and got[3][2] == []


def test_index_and_articles_change_together(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    maintenance.create_tables(store, buckets=3)
    arts = spark.sql("""select concat('a', id) id, concat('head ', id) headline, 't' ticker, cast(null as timestamp_ntz) pubdate,
                        if(id = 4, '', concat('text number ', id)) summary from range(6)""")
    store.commit({"articles": arts})
    encode = lambda a: vectors.hash_encode(a.withColumn("text", vectors.embed_text(joined=True)), keep=("ticker", "pubdate"))
    maintenance.refresh_index(store, encode, "2024-03-02 00:00:00", 30)
    assert {r.id: len(r.ivect) for r in store.read("index").collect()} == {f"a{i}": 1024 for i in range(6) if i != 4}
    old = {r.id: r.ivect for r in store.read("index").collect()}
    maintenance.delete_ids(store, spark.createDataFrame([("a1",), ("a1",), ("zz",)], "id string"))
    changed = arts.where("id != 'a1'").withColumn("summary", F.when(F.col("id") == "a2", "other words").otherwise(F.col("summary")))
    store.commit({"articles": changed})
    maintenance.refresh_index(store, encode, "2024-03-02 00:00:00", 30)
    new = {r.id: r.ivect for r in store.read("index").collect()}
    assert set(new) == {"a0", "a2", "a3", "a5"} and {i for i in new if new[i] != old[i]} == {"a2"}
    # at every version the index holds no id that the articles lack
    for v in store.history()[3:]:
        assert not {r.id for r in store.read("index", v).collect()} - {r.id for r in store.read("articles", v).collect()}


def test_copies_of_a_row_stay_few_where_bounds_leave_every_cell(spark):
    x = clustered(1200, 64, 1200, 1, 11)
    tiles, _, _ = V._tiles(frame(spark, x, tickers=1), 0.3, "id", "ticker", "vec", "id", 16)
    assert tiles.count() <= 20 * 1200
    got = {(r.a, r.b) for r in V.similar_pairs(frame(spark, x, tickers=1), 0.3, tile_size=16).collect()}
    assert got == {(i, j) for j in range(1200) for i in np.flatnonzero(x[:j] @ x[j] >= 0.3)} and got


def test_clustering_gets_no_texts(spark):
    arts = spark.createDataFrame([("a", None, "head", "long summary")], "id string, ticker string, headline string, summary string")
    rows = maintenance._rated(arts, lambda a: a.select("id", F.array(F.lit(1.0)).alias("vec")))
    assert {c: rows.first()[c] for c in rows.columns} == {"id": "a", "ticker": "UNK", "quality": 14.0, "vec": [1.0]}
