"""Non-SQL operators against brute force, plus table-maintenance invariants."""

import numpy as np

from pyspark.sql import functions as F

from riskfold.operators import news, vector_index, vectors


def _sequential_greedy(ids, vecs, groups, threshold):
    """The reference's in-order greedy clustering, per group, written plainly."""
    delete = set()
    for g in sorted(set(groups)):
        idx = [i for i in range(len(ids)) if groups[i] == g]
        used = set()
        for p, i in enumerate(idx):
            if i in used:
                continue
            cluster = [i]
            for j in idx[p + 1:]:
                if j in used:
                    continue
                if float(np.dot(vecs[i], vecs[j])) >= threshold:
                    cluster.append(j)
            for k in cluster:
                used.add(k)
            if len(cluster) > 1:
                best = max(cluster, key=lambda k: (QUALITY[k], -k))
                delete.update(ids[k] for k in cluster if k != best)
    return delete


QUALITY = {}


def test_greedy_dedupe_matches_sequential(spark):
    rng = np.random.default_rng(7)
    n = 160
    base = rng.normal(size=(6, 16))
    vecs = base[rng.integers(0, 6, n)] + 0.6 * rng.normal(size=(n, 16))
    vecs = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    groups = [f"g{int(x)}" for x in rng.integers(0, 3, n)]
    summaries = ["x" * int(k) for k in rng.integers(1, 50, n)]
    QUALITY.clear()
    QUALITY.update({i: len(summaries[i]) for i in range(n)})
    rows = [(i, groups[i], [float(x) for x in vecs[i]], "", summaries[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, ticker string, vec array<double>, headline string, summary string")
    got = {r.id for r in vectors.dedupe_similar(df, 0.8, tile_size=16).collect()}
    assert got == _sequential_greedy(list(range(n)), vecs, groups, 0.8)
    assert got  # the fixture does produce clusters


def test_similar_pairs_tiles_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 8))
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, "t", [float(x) for x in v[i]]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, ticker string, vec array<double>")
    got = {(r.a, r.b) for r in vector_index.similar_pairs(df, 0.5, tile_size=7).collect()}
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if v[i] @ v[j] >= 0.5}
    assert got == want


def test_topk_equals_full_sort(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(200, 8))
    rows = [(i, f"t{i % 3}", [float(x) for x in v[i]]) for i in range(200)]
    idx = spark.createDataFrame(rows, "id long, ticker string, vec array<double>").repartition(5)
    q = rng.normal(size=(3, 8))
    qn = q / (np.linalg.norm(q, axis=1, keepdims=True))
    qdf = spark.createDataFrame([("a", [float(x) for x in qn[0]], None), ("b", [float(x) for x in qn[1]], "t1"),
                                 ("c", [float(x) for x in qn[2]], None)], "qid string, qvec array<double>, qticker string")
    got = {}
    for r in vector_index.scan(idx, qdf, k=7).collect():
        got.setdefault(r.qid, []).append((r.rank, r.id))
    vn = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-8)
    for name, j, tick in (("a", 0, None), ("b", 1, "t1"), ("c", 2, None)):
        ok = [i for i in range(200) if tick is None or f"t{i % 3}" == tick]
        want = sorted(ok, key=lambda i: (-(vn[i] @ qn[j]), i))[:7]
        assert [i for _, i in sorted(got[name])] == want


def test_upsert_ignore_idempotent_and_first_wins(spark):
    t = spark.createDataFrame([("a", 1, 0)], "id string, v int, src_order long")
    b = spark.createDataFrame([("a", 9, 1), ("b", 2, 2), ("b", 3, 3)], "id string, v int, src_order long")
    once = news.upsert_ignore(t, b)
    twice = news.upsert_ignore(once, b)
    assert sorted(map(tuple, once.select("id", "v").collect())) == [("a", 1), ("b", 2)]
    assert sorted(map(tuple, twice.select("id", "v").collect())) == [("a", 1), ("b", 2)]
    over = news.upsert_overwrite(t, b, order="src_order")
    assert sorted(map(tuple, over.select("id", "v").collect())) == [("a", 9), ("b", 3)]


def test_retention_keeps_undated(spark):
    df = spark.createDataFrame([("old", "2024-01-01 00:00:00"), ("new", "2024-03-01 00:00:00"), ("none", None)],
                               "id string, p string").select("id", F.col("p").cast("timestamp_ntz").alias("pubdate"))
    kept, purged = news.retention_split(df, "2024-03-02 00:00:00", 14)
    assert sorted(r.id for r in kept.collect()) == ["new", "none"]
    assert [r.id for r in purged.collect()] == ["old"]


def test_greedy_dedupe_with_exact_copies(spark):
    rng = np.random.default_rng(9)
    n = 120
    base = rng.normal(size=(4, 12))
    vecs = base[rng.integers(0, 4, n)] + 0.5 * rng.normal(size=(n, 12))
    vecs = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    for i in range(0, n, 3):          # every third row is an exact copy of an earlier row
        vecs[i] = vecs[int(rng.integers(0, max(1, i)))] if i else vecs[i]
    groups = [f"g{int(x)}" for x in rng.integers(0, 2, n)]
    for i in range(0, n, 3):
        j = [k for k in range(i) if (vecs[k] == vecs[i]).all()]
        if j:
            groups[i] = groups[j[0]]
    summaries = ["y" * int(k) for k in rng.integers(1, 40, n)]
    QUALITY.clear()
    QUALITY.update({i: len(summaries[i]) for i in range(n)})
    rows = [(i, groups[i], [float(x) for x in vecs[i]], "", summaries[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, ticker string, vec array<double>, headline string, summary string")
    got = {r.id for r in vectors.dedupe_similar(df, 0.75, tile_size=10).collect()}
    assert got == _sequential_greedy(list(range(n)), vecs, groups, 0.75)


def test_cleanup_and_news_batch_return_every_row(spark):
    from conftest import SF_SMALL
    from riskfold.plans import bindings as B, vector_plans as P
    rows = {str(r.id): r for r in P.items(spark, SF_SMALL).withColumn("pubdate", B.pubdate_of("id")).collect()}
    out = P.q_cleanup(spark, SF_SMALL).collect()
    assert sorted(r.id for r in out) == sorted(rows) and len(out) > 10
    cut = np.datetime64(B.AS_OF[:10]) - 14
    live = []
    for r in out:
        day = rows[r.id].pubdate
        assert (r.state == "expired") == (day is not None and np.datetime64(day.replace(tzinfo=None)) < cut)
        assert (r.anchor is not None) == (r.state == "duplicate")
        assert r.ivect_bytes == (4 * len(rows[r.id].vec) if r.state == "kept" else None)
        if r.state != "expired":
            live.append(int(r.id))
    live.sort()
    text = lambda i, c: getattr(rows[str(i)], c) or ""
    QUALITY.clear()
    QUALITY.update({k: len(text(i, "summary")) + 0.5 * len(text(i, "headline")) for k, i in enumerate(live)})
    gone = _sequential_greedy(live, [np.array(rows[str(i)].vec) for i in live], [rows[str(i)].ticker for i in live], P.SIM_THRESHOLD)
    assert {int(r.id) for r in out if r.state == "duplicate"} == gone
    kept = {r.id for r in out if r.state == "kept"}
    assert len(kept) > 10
    preview = P.q_cleanup_preview(spark, SF_SMALL).collect()
    assert len(preview) == 10 and {r.id for r in preview} <= kept

    batch = P.q_news_batch(spark, SF_SMALL).collect()
    ids = {r.id for r in news.preprocess(B.raw_news(spark, SF_SMALL)).select("id").collect()}
    assert sorted(r.id for r in batch) == sorted(ids) and len(ids) > 10
    assert {r.state for r in batch} >= {"kept", "expired"}
    assert {r.ivect_bytes for r in batch if r.state == "kept"} <= {None, 4 * vectors.DIM_TOTAL}
    indexed = {r.id for r in batch if r.ivect_bytes}
    assert len(indexed) > 10
    preview = P.q_news_batch_preview(spark, SF_SMALL).collect()
    assert len(preview) == 10 and {r.id for r in preview} <= indexed


def test_preprocess_carries_kept_columns(spark):
    raw = spark.createDataFrame([(1, "t", "head", "en"), (2, "t", "other", None)], "`Doc Id` long, Ticker string, Title string, Lang string")
    got = {r.src_order: (r.headline, r.lang) for r in news.preprocess(raw, order="Doc Id", keep=("lang",)).collect()}
    assert got == {1: ("head", "en"), 2: ("other", None)}
