"""Versioned tables: whole versions only, several tables together, replay."""

import pytest
from pyspark.sql import types as T

from riskfold.sources.versioned import VersionedStore

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.LongType())])


def rows(df):
    return sorted(map(tuple, df.collect()))


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_create_commit_read(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    store.create("a", SCHEMA, ["id"])
    store.create("a", SCHEMA, ["id"])  # there already: nothing happens
    assert rows(store.read("a")) == []
    with pytest.raises(ValueError, match="other columns or keys"):
        store.create("a", SCHEMA, ["v"])
    with pytest.raises(ValueError, match="missing required columns"):
        store.create("b", SCHEMA, ["nothing"])
    v1 = store.commit({"a": frame(spark, [("x", 1)])})
    v2 = store.commit({"a": store.read("a").unionByName(frame(spark, [("y", 2)]))})
    assert rows(store.read("a")) == [("x", 1), ("y", 2)]
    assert rows(store.read("a", v1)) == [("x", 1)]  # the snapshot of K8
    assert rows(VersionedStore(spark, str(tmp_path / "s")).read("a", v2)) == [("x", 1), ("y", 2)]


def test_stopped_between_the_steps(spark, tmp_path, monkeypatch):
    store = VersionedStore(spark, str(tmp_path / "s"))
    for name in ("a", "b"):
        store.create(name, SCHEMA, ["id"])
    store.commit({"a": frame(spark, [("x", 1)]), "b": frame(spark, [("x", 9)])})

    def stop(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(store, "_publish", stop)
    with pytest.raises(KeyboardInterrupt):  # all data written, not committed
        store.commit({"a": frame(spark, []), "b": frame(spark, [])})
    monkeypatch.undo()
    assert rows(store.read("a")) == [("x", 1)] and rows(store.read("b")) == [("x", 9)]
    # a commit file of which only a part was written is no version
    n = max(store._names())
    (tmp_path / "s" / "commits" / f"{n + 1:012d}.json").write_text('{"version": 9, "tab')
    assert rows(store.read("a")) == [("x", 1)]
    store.commit({"a": frame(spark, [("z", 3)])})
    assert rows(store.read("a")) == [("z", 3)] and rows(store.read("b")) == [("x", 9)]


def test_empty_refused_and_batches_once(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    store.create("a", SCHEMA, ["id"])
    store.commit({"a": frame(spark, [("x", 1)])}, batch="4", stream="news")
    before = store.state()["version"]
    with pytest.raises(ValueError, match="a is empty"):
        store.commit({"a": frame(spark, [])}, allow_empty=False)
    assert store.commit({"a": frame(spark, [("replayed", 1)])}, batch="4", stream="news") == before
    assert rows(store.read("a")) == [("x", 1)]
    store.commit({"a": frame(spark, [("y", 2)])}, batch="5", stream="news")
    assert rows(store.read("a")) == [("y", 2)]
    with pytest.raises(ValueError, match="create it first"):
        store.commit({"unknown": frame(spark, [])})


def test_expire_keeps_what_is_named(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    store.create("a", SCHEMA, ["id"])
    store.create("b", SCHEMA, ["id"])
    store.commit({"a": frame(spark, [("x", 1)]), "b": frame(spark, [("only", 1)])})
    for k in range(4):
        store.commit({"a": frame(spark, [("x", k)])})
    assert store.expire(keep=2) == 3
    assert rows(store.read("a")) == [("x", 3)] and rows(store.read("b")) == [("only", 1)]
    assert len(store.history()) == 2


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    data = [(f"k{i}", i) for i in range(200)]
    for name in ("a", "b"):
        store.create(name, SCHEMA, ["id"], buckets=4)
    store.commit({n: frame(spark, data) for n in ("a", "b")})
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for s in (store, VersionedStore(spark, str(tmp_path / "s"))):  # the second finds the folders only
            joined = s.read("a").join(s.read("b"), "id")
            assert joined.count() == 200
            assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
