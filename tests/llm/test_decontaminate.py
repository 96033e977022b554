import pytest
import random
import re

import numpy as np

from riskfold.llm import decontaminate as D
from riskfold.llm.words import documents
from conftest import SF_ORACLE


def words(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())


def slow(q, p):
    """Smith-Waterman, cell by cell."""
    best, end, row = 0, 0, [0] * (len(p) + 1)
    for x in q:
        new = [0]
        for j, y in enumerate(p, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[-1] - 1))
        row = new
        if max(row) > best:
            best = max(row)
    return best


def test_alignment_equals_cell_by_cell():
    rng = random.Random(5)
    qs = [[rng.randrange(2, 9) for _ in range(rng.randrange(1, 30))] for _ in range(80)]
    ps = [[rng.randrange(2, 9) for _ in range(rng.randrange(1, 60))] for _ in range(80)]
    score, end = D.align([np.array(q, np.uint64) for q in qs], [np.array(p, np.uint64) for p in ps])
    assert score.tolist() == [slow(q, p) for q, p in zip(qs, ps)]
    for q, p, s, e in zip(qs, ps, score, end):
        assert s == slow(q, p[:e])
        assert e == 0 or p[e - 1] in q  # a best alignment ends on an equal word


def edited(rng, ws, share):
    out = []
    for w in ws:
        r = rng.random()
        if r < share / 3:
            continue
        out.append("swapped" + str(rng.randrange(99)) if r < 2 * share / 3 else w)
        if r > 1 - share / 3:
            out.append("added")
    return out


def test_exact_and_edited_copies_and_clean_documents(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(600)] + ["the", "of", "and"] * 60
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(15, 60)))) for i in range(25)]
    rows, planted = [], set()
    for d in range(300):
        ws = rng.choices(vocab, k=rng.randrange(5, 300))
        # item 0 leaks into a third of all documents
        for i in ([0] if d % 3 == 0 else []) + ([rng.randrange(1, 25)] if d % 4 == 1 else []):
            at = rng.randrange(len(ws) + 1)
            copy = edited(rng, items[i][1].split(), rng.choice([0, 0, 0.15]))
            ws[at:at] = [w.upper() if d % 2 else w for w in copy]
            planted.add((d, i))
        rows.append((d, "".join(w + rng.choice([" ", ", ", ".\n"]) for w in ws)))
    got = D.find_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3),
                        spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted
    text, item = dict(rows), dict(items)
    for r in got:
        span = words(text[r.doc_id])[r.first_word:r.last_word + 1]
        q = words(item[r.item_id])
        assert abs(slow(q, span) / (2 * len(q)) - r.score) < 1e-9
        assert span[0] in q and span[-1] in q


def test_edge_rows(spark):
    items = [(1, "one two"), (2, None), (3, ""), (4, "alpha beta gamma delta epsilon zeta eta"), (5, "alpha beta gamma delta epsilon zeta eta"),
             (6, "uno dos tres"), (None, "red green blue white black grey")]
    rows = [(1, None), (2, ""), (None, "x alpha, beta gamma delta epsilon zeta eta y"), (4, "one two"), (5, "Uno dos tres."), (6, "uno dos"),
            (7, "a b " * 30000 + "alpha beta gamma delta epsilon zeta eta"), (8, "red green blue white black grey"), (8, "red green blue white black grey"),
            (9, "alpha beta gamma delta epsilon zeta eta " * 3)]
    docs = spark.createDataFrame([(a, b, 1, "s") for a, b in rows], "doc_id long, text string, item_id int, score string")
    bench = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int")
    got = sorted(((r.doc_id, r.item_id) for r in D.find_copies(docs, bench).collect()), key=repr)
    want = [(None, 4), (None, 5), (5, 6), (7, 4), (7, 5), (8, None), (8, None), (9, 4), (9, 5)]
    assert got == sorted(want, key=repr)
    assert D.find_copies(docs.limit(0), bench).count() == 0
    assert D.find_copies(docs, bench.limit(0)).count() == 0
    left = D.remove_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 4, 6]


def test_blocks_of_a_large_benchmark(spark, monkeypatch):
    docs, bench = documents(spark, SF_ORACLE), spark.read.parquet(f"{SF_ORACLE}/benchmark.parquet")
    key = lambda df: sorted((r.doc_id, r.item_id, round(r.score, 6)) for r in df.collect())
    whole = key(D.find_copies(docs, bench))
    monkeypatch.setattr(D, "BLOCK_CHARS", 3000)
    assert key(D.find_copies(docs, bench)) == whole


def test_query_finds_every_verbatim_item(spark):
    docs = documents(spark, SF_ORACLE).collect()
    items = spark.read.parquet(f"{SF_ORACLE}/benchmark.parquet").collect()
    verbatim = {(d.doc_id, i.item_id) for i in items for d in docs if " ".join(words(i.text)) in " ".join(words(d.text))}
    got = {(r.doc_id, r.item_id): r.score for r in D.op1_decontaminate(spark, SF_ORACLE).collect()}
    assert verbatim and verbatim <= set(got)
    assert all(got[v] == 1.0 for v in verbatim)


@pytest.mark.parametrize("kind", ["int", "bigint", "string", "decimal(10,0)", "binary", "date"])
def test_item_ids_of_any_type(spark, kind):
    text = " ".join(f"rare{i}" for i in range(20))
    cast = {"binary": "cast('a' as binary)", "date": "date'2024-01-01'"}.get(kind, f"cast(7 as {kind})")
    bench = spark.sql(f"select {cast} as item_id, '{text}' as text")
    docs = spark.createDataFrame([(1, "before " + text + " after"), (2, "clean words only")], "doc_id int, text string")
    (hit,) = D.find_copies(docs, bench).collect()
    assert (hit.doc_id, hit.item_id, hit.score) == (1, bench.first().item_id, 1.0)


def test_long_excerpt_of_a_long_item(spark):
    rng = random.Random(4)
    item = [f"v{rng.randrange(4000)}" for _ in range(200)]
    filler = [f"v{rng.randrange(4000)}" for _ in range(5000)]
    edited = item[60:130]
    edited[20:22] = ["other", "words", "here"]
    docs = [(1, " ".join(filler[:300] + item[60:130] + filler[300:])), (2, " ".join(filler[:500] + edited + filler[500:900])),
            (3, " ".join(filler)), (4, " ".join(filler[:100] + item[100:125] + filler[100:200]))]
    found = D.find_copies(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("i", " ".join(item))], "item_id string, text string"))
    assert {r.doc_id: r.first_word for r in found.collect()} == {1: 300, 2: 500}
