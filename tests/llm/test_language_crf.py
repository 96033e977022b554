import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskfold.llm import language_crf as L
from riskfold.llm.words import documents
from conftest import SF_ORACLE

RNG = np.random.default_rng(3)


def brute(score, moves):
    """Marginals and expected moves by listing every path."""
    n, k = score.shape
    paths = list(itertools.product(range(k), repeat=n))
    weight = np.array([np.exp(sum(score[t, p[t]] for t in range(n)) + sum(moves[a, b] for a, b in zip(p, p[1:]))) for p in paths])
    m, e = np.zeros((n, k)), np.zeros((k, k))
    for p, w in zip(paths, weight / weight.sum()):
        for t in range(n):
            m[t, p[t]] += w
        for a, b in zip(p, p[1:]):
            e[a, b] += w
    return m, e, np.log(weight.sum())


def test_forward_backward_equals_listing_paths():
    lengths = [4, 0, 1, 6, 4]
    first = np.concatenate(([0], np.cumsum(lengths)))
    score, moves = RNG.normal(size=(sum(lengths), 3)) * 2, RNG.normal(size=(3, 3))
    got, moved, total = L.marginals(score, first, moves, expected=True)
    want_moves, want_total = np.zeros((3, 3)), 0.0
    for a, b in zip(first[:-1], first[1:]):
        if b > a:
            m, e, z = brute(score[a:b], moves)
            np.testing.assert_allclose(got[a:b], m, atol=1e-9)
            want_moves += e
            want_total += z
    np.testing.assert_allclose(moved, want_moves, atol=1e-9)
    assert abs(total - want_total) < 1e-8


def test_code_switched_text_is_labelled_word_by_word():
    en = ["the of thing there that", "with the other there and of", "that thing and the other with"] * 12
    de = ["der und nicht schlecht ist", "ein schlicht und recht der ist", "nicht recht ein und der"] * 12
    model = L.train([(t, "en") for t in en] + [(t, "de") for t in de])
    p, first = L.word_marginals(model, ["the other thing and that der nicht schlecht und ist there with the"])
    best = [model.langs[i] for i in p.argmax(axis=1)]
    assert best == ["en"] * 5 + ["de"] * 5 + ["en"] * 3
    assert (np.diag(model.moves) > model.moves[[0, 1], [1, 0]]).all()


def test_features_do_not_depend_on_neighbours():
    a, b = L.Tokens(["Été hello x"]), L.Tokens(["zz hello", "Été", "x " + "y" * 40])
    fa = {h: sorted(set(f[f > 0])) for h, f in zip(a.hashes, L.feature_ids(a))}
    fb = {h: sorted(set(f[f > 0])) for h, f in zip(b.hashes, L.feature_ids(b))}
    assert len(set(fa) & set(fb)) == 3
    for h in set(fa) & set(fb):
        assert fa[h] == fb[h]


def test_held_out_accuracy_and_contract(spark):
    docs = {r.doc_id: r for r in documents(spark, SF_ORACLE).collect()}
    out = L.op4_language_crf(spark, SF_ORACLE).collect()
    assert len(out) == documents(spark, SF_ORACLE).count()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    right = sum(docs[r.doc_id].lang == r.lang_pred for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_prediction_ignores_lang_source_and_id(spark):
    docs = documents(spark, SF_ORACLE).select("doc_id", "text", "lang")
    model = L.fit(docs)
    assert L.fit(docs.repartition(7)).weights.tobytes() == model.weights.tobytes()
    a = [(r.lang_pred, round(r.score, 5)) for r in L.predict(docs.where("doc_id < 40").orderBy("doc_id"), model).collect()]
    other = docs.where("doc_id < 40").selectExpr("doc_id", "-doc_id as d", "text", "'xx' as lang", "1 as lang_pred")
    b = [(r.lang_pred, round(r.score, 5)) for r in L.predict(other.orderBy("doc_id"), model).collect()]
    assert a == b


def test_edge_rows(spark):
    docs = documents(spark, SF_ORACLE).select("doc_id", "text", "lang")
    model = L.fit(docs)
    rows = [(1, None), (2, ""), (3, "12 345 !? — …"), (4, "the of and that with"), (None, "the of and"), (4, "the of and that with"), (5, "the of " * 40000), (6, "語 日本")]
    df = spark.createDataFrame([(a, b, "clash", 1.0) for a, b in rows], "doc_id long, text string, c0 string, score double")
    got = [(r.doc_id, r.lang_pred) for r in L.predict(df, model).collect()]
    assert got[:7] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "en"), (4, "en"), (5, "en")]
    assert got[7][1] in model.langs
    assert {r.lang_pred for r in L.predict(df, None).collect()} == {"und"}
    assert L.predict(df.limit(0), model).count() == 0
    unlabelled = docs.limit(5).selectExpr("doc_id", "text", "nullif(lang, lang) as lang")
    assert L.fit(unlabelled) is None


def test_stage_keeps_clean_rows_as_they_are(spark):
    docs = documents(spark, SF_ORACLE)
    mixed = docs.unionByName(docs.limit(3).selectExpr("doc_id + 100000 as doc_id", "'12 34' as text", "lang", "source", "n_chars"))
    kept = L.keep_known(mixed)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect())


def test_stage_without_labels_and_with_code_switched_texts(spark):
    rows = [(i, "the other thing and that with " * 5, "en") for i in range(30)] + [(100 + i, "der und nicht recht schlicht ist " * 5, "de") for i in range(30)]
    rows += [(200, "the other thing and der nicht recht schlicht that with und ist", None), (201, "12 34", None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in df.collect()} - {r.doc_id for r in L.keep_known(df).collect()} == {201, None}
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(L.keep_known(unlabelled).collect(), key=repr) == sorted(unlabelled.collect(), key=repr)


@pytest.mark.parametrize("passages", [[("only one language here", "en")], [("a", "x"), ("", "y")]])
def test_tiny_training_sets(passages):
    assert L.train(passages).langs == sorted({g for _, g in passages})


def test_ngrams_cover_every_byte_of_a_word():
    words = ["a", "é", "ab" * 11 + "cd", "x" * 23 + "yz", "x" * 60 + "yz" + "x" * 60, "東京は日本の首都です。" * 20]
    tokens = L.Tokens(words)
    by_hash = {h: np.sort(f[f > 0]) for h, f in zip(tokens.hashes, L.feature_ids(tokens))}

    def number(value, kind):
        h = (value * 2654435761 + kind * 40503 + 7) % (1 << 32) * 2246822519 % (1 << 32)
        return 1 + (h >> 15) % (L.FEATURES - 1)
    for w in words:
        b = w.encode()
        m = [1, *b, 2]
        want = [number(m[i] << 8 | m[i + 1], 1) for i in range(len(m) - 1)]
        want += [number((m[i] << 8 | m[i + 1]) << 8 | m[i + 2], 2) for i in range(len(m) - 2)]
        for k in range(1, min(4, len(b)) + 1):
            want += [number(int.from_bytes(b[:k], "little"), 10 + k), number(int.from_bytes(b[-k:][::-1], "little"), 20 + k)]
        assert by_hash[L.Tokens([w]).hashes[0]].tolist() == sorted(want)


def test_languages_without_blanks_are_sampled_and_told_by_their_whole_text(spark):
    rng = np.random.default_rng(5)
    parts = {"aa": ["のです", "東京は", "でした", "から"], "bb": ["的是", "我们", "不了", "他在"]}
    same = "一二三四五六七八九十"

    def text(g):
        return same + "".join(rng.choice(parts[g], 150)) + same
    rows = [(i, text(g), g) for i, g in enumerate(["aa", "bb"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    passages = L.sample_passages(df)
    assert {g for _, g in passages} == {"aa", "bb"}
    assert all(p and max(map(len, p.split())) <= L.PIECE for p, _ in passages)
    by_text = {t: g for _, t, g in rows}
    assert {p.replace(" ", "") for p, _ in passages} <= set(by_text)
    told = L.predict(df, L.fit(df)).collect()
    assert [r.lang_pred for r in sorted(told, key=lambda r: r.doc_id)] == [g for _, _, g in rows]
