import hashlib

from pyspark.sql import functions as F

from riskfold.llm import mixing as M
from conftest import SF_SMALL


def fill(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), share * sum(sizes.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= epochs * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = epochs * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def brute(rows):
    size = [len((t or "").split()) for _, _, t in rows]
    per = {}
    for (_, s, _), n in zip(rows, size):
        per[s] = per.get(s, 0) + n
    target = fill(per)
    queue = {}
    for (i, s, t), n in zip(rows, size):
        for e in (1, 2):
            if n:
                h = hashlib.md5((t or "").encode()).hexdigest()
                k = hashlib.md5(f"mix:{e}:{'' if i is None else i}:{h}".encode()).hexdigest()[:16]
                queue.setdefault(s, []).append((e, k, (i, h), n))
    copies = []
    for s, q in queue.items():
        q.sort(key=lambda x: x[:2])
        for e, k, i, n in q:
            done = sum(m for f, l, _, m in q if (f, l) <= (e, k))
            copies.append((done / target[s], (s is None, s or ""), e, k, i, n))
    copies.sort(key=lambda x: x[:4])
    taken = {}
    for c in copies:
        if sum(x[5] for x in copies if x[:4] <= c[:4]) <= sum(target.values()):
            taken[c[4], c[1]] = taken.get((c[4], c[1]), 0) + 1
    return sorted(((i, n, per[s], round(target[s], 6), n * min(2, taken.get(((i, hashlib.md5((t or "").encode()).hexdigest()), (s is None, s or "")), 0)))
                   for (i, s, t), n in zip(rows, size)), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, text string, target_text string, copies_of int")
    out = M.mix(df)
    assert out.columns[:5] == df.columns
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.size * r.copies) for r in out.collect()), key=repr)


def test_small_mix_equals_brute_force(spark):
    rows = [(i, ["b", "a", None, "c", "é"][i * i % 5], "w " * (i * 7 % 23)) for i in range(120)]
    assert run(spark, rows) == brute(rows)


def test_nulls_empty_texts_and_empty_table(spark):
    rows = [(1, None, None), (2, "a", ""), (None, "a", "x y z"), (4, "a", "one two three"), (5, "z", "   ")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:1] + rows[4:]) == [(1, 0, 0, 0.0, 0), (5, 0, 0, 0.0, 0)]
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert M.mix(df).count() == 0


def test_one_source_with_a_third_and_one_very_long_text(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 9}", "w " * (1 + i % 5)) for i in range(200)] + [(500, "long", "w " * 5000)]
    assert run(spark, rows) == brute(rows)


def test_shares_come_near_targets_and_reruns_agree(spark):
    a, b = M.op7_fair_mix(spark, SF_SMALL), M.op7_fair_mix(spark, SF_SMALL)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.repartition(7).collect()))
    assert a.where("taken > 2 * size or taken < 0").count() == 0
    per = a.groupBy("target", "source_size").agg(F.sum("taken").alias("t"), F.max("size").alias("m")).collect()
    for r in per:
        assert abs(r.t - r.target) <= 2 * r.m, r


def test_a_third_without_ids_comes_near_its_targets(spark):
    df = spark.range(6000).selectExpr("if(id % 3 = 0, null, id) as doc_id", "concat('s', id % 4) as source",
                                      "concat('t', id, repeat(' w', cast(5 + id % 40 as int))) as text")
    per = M.mix(df).groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("t")).collect()
    assert len(per) == 4 and all(abs(r.t / r.target - 1) < 0.05 for r in per)
