import tempfile
import uuid

import corpus_pipeline as C
from riskfold.llm import decontaminate, language_crf
from riskfold.llm.words import documents
from conftest import SF_SMALL
from .test_decontaminate import words
from .test_mixing import brute as mixed
from .test_simhash import roots, slow_fingerprint
from .test_token_pack import direct


def test_each_stage_against_brute_force(spark):
    docs = documents(spark, SF_SMALL)
    columns, folder = docs.columns, f"{tempfile.mkdtemp()}/{uuid.uuid4().hex}"
    outs = {}
    for name, stage in C.STAGES:
        stage(spark, docs, SF_SMALL).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        outs[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == columns
    given = documents(spark, SF_SMALL).collect()
    known = outs["language"]
    told = language_crf.predict(documents(spark, SF_SMALL), language_crf.fit(documents(spark, SF_SMALL)))
    assert sorted(known) == sorted(r for r in given if any(map(str.isalpha, r.text or "")) and r in known)
    assert len(known) == told.where("lang_pred != 'und'").count()

    fps = [slow_fingerprint(r.text) for r in known]
    group = roots(len(known), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    least = {}
    for g, r in zip(group, known):
        least[g] = min(r.doc_id, least.get(g, r.doc_id))
    single = outs["near_copies"]
    assert sorted(r.doc_id for r in single) == sorted(set(least.values()))
    assert set(single) <= set(known)

    items = [words(r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    clean = outs["decontaminate"]
    assert not any(" ".join(i) in " ".join(words(r.text)) for r in clean for i in items)
    dropped = set(single) - set(clean)
    assert set(clean) <= set(single)
    for r in dropped:  # every dropped document holds a passage that aligns with an item
        assert any(set(i) and len(set(i) & set(words(r.text))) >= 0.4 * len(set(i)) for i in items)

    want = mixed([(r.doc_id, r.source, r.text) for r in clean])
    copies = {}
    for r in outs["mixing"]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {i: taken // n for i, n, _, _, taken in want if taken}
    assert set(outs["mixing"]) <= set(clean)

    tokens = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in outs["tokens"]), key=lambda r: r[1])
    assert tokens == direct([(r.doc_id, r.text) for r in outs["mixing"]])


def test_run_gives_the_last_stage(spark):
    out = C.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


def test_empty_documents(spark):
    docs = documents(spark, SF_SMALL).limit(0)
    for _, stage in C.STAGES[1:]:
        assert stage(spark, docs, SF_SMALL).count() == 0
    assert decontaminate.remove_contaminated(docs, spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")).count() == 0
    assert C.STAGES[0][1](spark, docs, SF_SMALL).count() == 0


def test_stages_with_null_ids_and_clashing_columns(spark):
    """Null and shared ids, null and odd texts, extra columns whose names the stages use themselves."""
    given = documents(spark, SF_SMALL).select("doc_id", "text", "lang", "source", "n_chars")
    docs = (given.selectExpr("if(doc_id % 3 = 0, null, if(doc_id % 3 = 1, 7, doc_id)) as doc_id", "text", "lang", "source", "n_chars",
                             "doc_id as id", "'x' as row", "1 as copies", "2 as size", "'y' as __key")
            .unionByName(spark.sql("""select cast(null as bigint) doc_id, text, cast(null as string) lang, cast(null as string) source, cast(0 as bigint) n_chars,
                                      cast(null as bigint) id, 'x' row, 1 copies, 2 size, 'y' __key from values (cast(null as string)), (''), (' 1 ') as t(text)"""),
                         allowMissingColumns=True))
    columns, count = docs.columns, docs.count()
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF_SMALL)
        folder = f"{tempfile.mkdtemp()}/{uuid.uuid4().hex}"
        out.write.parquet(folder)
        docs = spark.read.parquet(folder)
        if name != "tokens":
            assert docs.columns == columns
        left, count = count, docs.count()
        assert 0 < count <= 2 * left
        if name == "near_copies":  # rows without an id of their own are told apart by their texts
            assert docs.where("doc_id is null").count() > 20 and docs.where("doc_id = 7").count() > 20


def test_unlabelled_corpus_reaches_the_end(spark):
    docs = documents(spark, SF_SMALL).selectExpr("doc_id", "text", "nullif(lang, lang) as lang", "source", "n_chars")
    assert C.STAGES[0][1](spark, docs, SF_SMALL).count() == docs.count()
