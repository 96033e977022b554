import random

import numpy as np
import pytest

from riskfold.llm import substring_dedup as D
from riskfold.llm.words import documents
from conftest import SF_SMALL


def brute(rows):
    big = float("inf")
    first = {}
    cut = [(big if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, ws in cut:
        for a in range(len(ws) - 12):
            g = tuple(ws[a:a + 13])
            first[g] = min(i, first.get(g, big))
    out = []
    for (i, t), (k, ws) in zip(rows, cut):
        gone = {a + j for a in range(len(ws) - 12) if first[tuple(ws[a:a + 13])] < k for j in range(13)}
        out.append((i, len(ws), len(gone), b" ".join(w for j, w in enumerate(ws) if j not in gone).decode()))
    return sorted(out, key=repr)


def run(df, **how):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in D.remove_repeats(df, **how).collect()), key=repr)


def test_cover_meets_every_pair_of_positions():
    for i in range(D.PERIOD):
        for j in range(D.PERIOD):
            assert any((i + d) % D.PERIOD in D.COVER and (j + d) % D.PERIOD in D.COVER for d in range(D.PERIOD))
    assert D.WINDOW == 13


def planted(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}é" for i in range(3000)]
    pool = [rng.choices(vocab, k=rng.choice([12, 13, 14, 20, 60])) for _ in range(12)]
    rows = []
    for i in rng.sample(range(10_000), 150):
        ws = rng.choices(vocab, k=rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            p, at = rng.choice(pool), rng.randrange(len(ws) + 1)
            a = rng.randrange(0, 3)
            ws[at:at] = p[a:len(p) - rng.randrange(0, 3)]
        if rng.random() < 0.4:
            ws[0:0] = pool[0]
        rows.append((i, "".join(w + rng.choice([" ", "\n", "  ", "\t "]) for w in ws)))
    return rows


@pytest.mark.parametrize("frequent", [2, 3, 50])
def test_planted_passages(spark, frequent):
    rows = planted(frequent)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(df, frequent=frequent) == brute(rows)
    assert run(df, frequent=frequent, sample_docs=20) == brute(rows)


def test_edge_rows_and_clashing_columns(spark):
    long = " ".join(f"x{i}" for i in range(40))
    rows = [(1, long), (1, long), (0, "short text"), (None, long), (5, None), (6, ""), (7, " \n "), (8, long + "\n" + long), (3, "a " * 30000), (4, "a " * 20),
            (None, "a " * 14), (9, " ".join(f"x{i}" for i in range(12)))]
    df = spark.createDataFrame([(a, b, 1, "q") for a, b in rows], "doc_id long, text string, d int, windows string")
    assert run(df) == brute(rows)
    assert D.remove_repeats(df).columns == [*df.columns, "n_words", "n_removed", "kept_text"]
    assert D.remove_repeats(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    import hashlib
    rows = [(r.doc_id, r.text) for r in documents(spark, SF_SMALL).collect()]
    want = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute(rows)]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in D.op2_substring_dedup(spark, SF_SMALL).collect()]
    assert sorted(got) == sorted(want)
    assert sum(r[2] for r in got) > 0


def test_anchor_count_is_three_of_seven():
    words = D.Words([" ".join(str(i) for i in range(7000))])
    at, h = D._anchors(words)
    assert len(at) == len(h) == 3 * 999 + 1  # the last of 6994 starts is 0 modulo 7
    assert len(np.unique(h)) == len(h)


def test_lists_of_rows_without_an_id_or_sharing_one_are_bounded_by_one_text(spark):
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(40)]
    texts = [" ".join([f"a{i}x{j}" for j in range(20)] + shared + [f"b{i}x{j}" for j in range(i % 5)]) for i in range(60)]
    rows = [(1, texts[0])] + [(None, t) for t in texts[1:30] * 2] + [(7, t) for t in texts[30:] * 2] + [(9, texts[3])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for frequent in (2, 1000):
        assert run(df, frequent=frequent) == brute(rows)
    given = df.select(D.id_or_last("doc_id").alias("d"), "text")
    keyed = D._with_row_key(given)
    assert {r.k == 0 for r in keyed.where("d in (1, 9)").collect()} == {True}
    none = np.zeros(0, np.uint64)
    anchors = D._shared_anchors(keyed, none)
    found = anchors.collect()
    longest = max(len(t.split()) for t in texts)
    assert len(found) == 61 and max(len(r.anchors) for r in found) <= longest
    windows = D._repeated_windows(D._candidate_windows(D._compact(keyed), anchors, none)).collect()
    assert windows and max(len(r.windows) for r in windows) <= longest
