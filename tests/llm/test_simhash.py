import random

import numpy as np
import pytest
import xxhash

from riskfold.llm import graph, simhash as S
from riskfold.llm.words import documents
from conftest import SF_SMALL


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    k = min(3, len(words))
    hs = [xxhash.xxh64(b" ".join(words[i:i + k]), 42).intdigest() for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(n, near):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(n):
        for j in range(i):
            if near(i, j):
                parent[find(i)] = find(j)
    return [find(i) for i in range(n)]


def brute(rows):
    big = (1 << 63) - 1
    fps = [slow_fingerprint(t) for _, t in rows]
    ids = [big if i is None else i for i, _ in rows]
    r = roots(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    least = {}
    for root, i in zip(r, ids):
        least[root] = min(i, least.get(root, big))
    null = lambda i: None if i == big else i
    return sorted(((null(i), f"{f:016x}", null(least[x])) for i, f, x in zip(ids, fps, r)), key=repr)


def run(df):
    out = S.near_duplicates(df).collect()
    rows = [(r.doc_id, f"{r.fp & (2 ** 64 - 1):016x}", r.component_id) for r in out]
    return sorted(rows, key=repr)


def test_edge_rows(spark):
    rows = [(5, "Same text of five words"), (3, "same TEXT of five  words"), (9, None), (8, ""), (7, " \n\t"), (4, "one"), (6, "ONE"),
            (2, "two words"), (None, "one"), (5, "Same text of five words"), (5, "another text"), (None, "alone here É x"), (11, "w " * 30000)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, fp string")
    assert run(df) == brute(rows)
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, SF_SMALL).collect()]
    out = sorted(map(tuple, S.op8_simhash_groups(spark, SF_SMALL).collect()), key=repr)
    assert out == brute(rows)


@pytest.mark.parametrize("split", [2, 4096])
@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_connect_what_brute_force_connects(spark, radius, split):
    rng = random.Random(radius)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 30])):
            fps.add(x)
            x ^= 1 << rng.randrange(64)
            x ^= 1 << rng.randrange(64)
    hub = rng.getrandbits(64)
    fps |= {hub ^ (1 << b) for b in range(64)}
    fps = sorted(fps)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    at = {s: i for i, s in enumerate(signed)}
    got = S.links(spark.createDataFrame([(s,) for s in signed], "fp long"), radius, split).collect()
    for r in got:
        assert (fps[at[r.u]] ^ fps[at[r.v]]).bit_count() <= radius
    pairs = {(at[r.u], at[r.v]) for r in got} | {(at[r.v], at[r.u]) for r in got}
    want = roots(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= radius)
    have = roots(len(fps), lambda i, j: (i, j) in pairs)
    group = lambda r: {frozenset(i for i in range(len(r)) if r[i] == x) for x in set(r)}
    assert group(want) == group(have)


def test_bit_sliced_distance():
    rng = np.random.default_rng(1)
    members = rng.integers(0, 1 << 63, (50, 64), dtype=np.uint64)
    q = members[:, 0] ^ np.uint64(1 << 5)
    members[:, 1] = q ^ np.uint64(0b111)
    members[:, 2] = ~q
    for radius in (0, 1, 2, 3, 7, 20):
        got = S.within(q, S.planes_of(members), radius)
        for i in range(50):
            for j in range(64):
                assert bool(int(got[i]) >> j & 1) == (int(q[i] ^ members[i, j]).bit_count() <= radius)


def test_components_of_chain_star_and_loops(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 2000 + i) for i in range(300)]
    df = spark.createDataFrame(chain + star + [(5000, 5000), (7, 3), (6000, 6001), (6001, 6000)], "u long, v long")
    got = {r.u: r.v for r in graph.components(df).collect()}
    want = {i: 0 for i in range(1, 301)} | {2000 + i: 1000 for i in range(300)} | {6001: 6000}
    assert got == want


def test_keep_first_keeps_every_column_and_one_row(spark):
    rows = [(1, "a b c d", "x"), (2, "A b c d", "y"), (1, "a b c d", "z"), (3, "other words here", "x"), (None, "a b c d", "x"), (4, None, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    out = S.keep_first(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]


def test_keep_first_keeps_one_row_of_each_component_not_of_each_id(spark):
    rows = [(None, "first text without an id"), (None, "quite another passage here"), (None, "FIRST text without an id"),
            (None, "quite another passage here"), (3, "a copied line of words"), (7, "A copied line of words"),
            (7, "something only seven has"), (7, "and one more unlinked thing"), (7, "something only seven has")]
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "doc_id long, text string, n long")
    out = S.keep_first(df).collect()
    big = (1 << 63) - 1
    fps = [slow_fingerprint(t) for _, t in rows]
    group = roots(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    assert len(out) == len(set(group)) == 5
    assert sorted(group[r.n] for r in out) == sorted(set(group))
    for r in out:
        assert rows[r.n] == (r.doc_id, r.text)
        assert (big if r.doc_id is None else r.doc_id) == min(
            big if i is None else i for (i, _), g in zip(rows, group) if g == group[r.n])
