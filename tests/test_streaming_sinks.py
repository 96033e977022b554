"""Streaming results equal their batch equivalents; sinks round-trip."""

import os
import tempfile

import pandas as pd
import pytest
import pyspark.sql.functions as F

from conftest import SF_SMALL
from riskfold.sources import files
from riskfold.sources.tables import read_table
from riskfold.streaming import jobs


def _events(spark, name):
    df = read_table(spark, SF_SMALL, "events")
    root = jobs.stream_root(spark, name)
    return jobs.file_stream(spark, jobs.land(df, "event_id", 3, f"{root}/landed"), df.schema), root


def test_stream_latest_equals_batch(spark):
    ev, root = _events(spark, "t-latest")
    t = jobs.latest_value_stream(spark, ev, "user_id", "ts", "value", root)
    got = {(r.user_id, r.latest_value) for r in t.collect()}
    assert len(jobs.DeltaTable(spark, f"{root}/table").batches()) == 3
    ev = read_table(spark, SF_SMALL, "events")
    want = {(r.user_id, r.v) for r in ev.groupBy("user_id").agg(F.max_by("value", "ts").alias("v")).collect()}
    assert got == want


def test_stream_dedup_first_event_wins(spark):
    ev, root = _events(spark, "t-dedup")
    t = jobs.dedup_stream(spark, ev.select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id", root)
    got = {(r.user_id, r.event_type, r.event_id) for r in t.read().collect()}
    b = read_table(spark, SF_SMALL, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("e"))
    assert got == {(r.user_id, r.event_type, r.e) for r in b.collect()}


def test_stream_resumes_at_its_root(spark):
    root = jobs.stream_root(spark, "t-resume")
    schema = "k string, n long"

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/landed")
        return jobs.dedup_stream(spark, jobs.file_stream(spark, f"{root}/landed", schema), ["k"], "n", root)

    first = land([("a", 3), ("b", 2), (None, 5)])
    assert {(r.k, r.n) for r in first.read().collect()} == {("a", 3), ("b", 2), (None, 5)}
    second = land([("a", 1), ("b", 4), ("c", 9), (None, 6)])     # an earlier "a" lands late
    assert {(r.k, r.n) for r in second.read().collect()} == {("a", 1), ("b", 2), ("c", 9), (None, 5)}
    assert {(r.k, r.n) for r in second.table.read().collect()} == {("a", 3), ("a", 1), ("b", 2), ("c", 9), (None, 5)}
    assert second.read(before=1).count() == 3                    # the snapshot before the second cycle


def test_retention_splits_every_row(spark):
    ev, root = _events(spark, "t-retention")
    kept, dead = jobs.retention_stream(spark, ev, "ts", 7, root, valid=F.col("value") >= 20.0)
    rows = read_table(spark, SF_SMALL, "events").toPandas()
    good = rows[rows.value >= 20.0]
    want = good[good.ts >= good.ts.max() - pd.Timedelta(days=7)]
    assert {r.event_id for r in kept.select("event_id").collect()} == set(want.event_id)
    assert {r.event_id for r in dead.select("event_id").collect()} == set(rows[~(rows.value >= 20.0)].event_id)
    assert len(want) and len(want) < len(good) < len(rows)


def test_replayed_batch_writes_the_same_rows(spark):
    root = jobs.stream_root(spark, "t-replay")
    store = jobs.KeyedStore(spark, root, ["id"], "n")
    old, new = (spark.createDataFrame(r, "id long, n long") for r in ([(1, 1), (2, 1)], [(2, 2), (3, 2)]))
    store.add(old, 0)
    store.add(new, 1)
    store.add(new, 1)
    assert store.table.batches() == [0, 1]
    assert {(r.id, r.n) for r in store.table.read().collect()} == {(1, 1), (2, 1), (3, 2)}


def test_universe_csv_roundtrip_and_missing_file(spark):
    root = tempfile.mkdtemp(prefix="riskfold-csv-")
    df = spark.createDataFrame([("A", "X", "12.5%", "-0.5", "N/A"), ("B", "Y", "0.2", "-0.3", "1,234.5")],
                               "ticker string, sector string, sigma string, mdd string, beta string")
    files.write_csv(df, os.path.join(root, "u"))
    back = {r.ticker: (r.sigma, r.mdd, r.beta) for r in files.load_universe(spark, os.path.join(root, "u")).collect()}
    assert back == {"B": (0.2, -0.3, 1.0)}
    assert files.load_fundamentals(spark, os.path.join(root, "absent.csv")).count() == 0


def test_snapshot_refuses_empty(spark):
    root = tempfile.mkdtemp(prefix="riskfold-snap-")
    files.snapshot_then_overwrite(spark.range(3), root)
    with pytest.raises(ValueError, match="is empty"):
        files.snapshot_then_overwrite(spark.range(0), root)
    store = files.snapshot_then_overwrite(spark.range(5), root)
    assert [store.read("current", v).count() for v in store.history()[1:]] == [3, 5]


def test_deltas_are_merged_and_expired_rows_leave_the_disk(spark, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT_EVERY", 3)
    root = jobs.stream_root(spark, "t-compact")
    schema = "k string, n long, ts timestamp"
    store = jobs.KeyedStore(spark, root, ["k"], "n", ts="ts", horizon_days=10)
    rows = [[(f"k{b}", b, day(b * 4)), ("same", b, day(b * 4)), (None, 50 - b, day(b * 4))] for b in range(8)]
    for b, r in enumerate(rows):
        df = spark.createDataFrame(r, schema)
        store.add(df, b)
        store.add(df, b)                                   # replayed at once
        if b == 5:
            assert store.table.base() == 2 and store.table.batches() == [3, 4, 5]
    assert store.table.base() == 5 and store.table.batches() == [6, 7]
    got = {(r.k, r.n) for r in store.read().collect()}
    # the horizon ends 10 days before the newest row: "same" is forgotten and comes again
    assert {(f"k{b}", b) for b in range(6, 8)} <= got and ("k0", 0) not in got
    assert {r.k for r in spark.read.parquet(f"{root}/base={store.table.base():012d}").collect()} & {"k0", "k1"} == set()
    with pytest.raises(ValueError, match="merged"):
        store.read(before=1)


def test_merged_deltas_give_the_same_result(spark, monkeypatch):
    ev, root = _events(spark, "t-plain")
    plain, dead = jobs.retention_stream(spark, ev, "ts", 7, root, valid=F.col("value") >= 20.0)
    monkeypatch.setattr(jobs, "COMPACT_EVERY", 1)
    for name, make in (("ret", lambda e, r: jobs.retention_stream(spark, e, "ts", 7, r, valid=F.col("value") >= 20.0)),
                       ("lat", lambda e, r: (jobs.latest_value_stream(spark, e, "user_id", "ts", "value", r),) * 2),
                       ("ded", lambda e, r: (jobs.dedup_stream(spark, e, ["user_id", "event_type"], "event_id", r).read(),) * 2)):
        ev, root = _events(spark, f"t-merge-{name}")
        got, other = make(ev, root)
        assert jobs.DeltaTable(spark, f"{root}/table").base() == 1
        if name == "ret":
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
            assert sorted(map(tuple, other.collect())) == sorted(map(tuple, dead.collect()))
        elif name == "lat":
            b = read_table(spark, SF_SMALL, "events").groupBy("user_id").agg(F.max_by("value", "ts").alias("v"))
            assert {(r.user_id, r.latest_value) for r in got.collect()} == {(r.user_id, r.v) for r in b.collect()}
        else:
            b = read_table(spark, SF_SMALL, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("e"))
            assert {tuple(r) for r in got.select("user_id", "event_type", "event_id").collect()} == {tuple(r) for r in b.collect()}


def day(n):
    return (pd.Timestamp("2024-01-01") + pd.Timedelta(days=n)).to_pydatetime()


def test_stopped_while_merging(spark, monkeypatch):
    table = jobs.DeltaTable(spark, jobs.stream_root(spark, "t-stop"))
    for b in range(3):
        table.write(spark.range(b * 10, b * 10 + 2), b)

    def broken(rows):
        return rows.select(F.raise_error(F.lit("lost")).cast("long").alias("id"))

    with pytest.raises(Exception, match="lost"):
        table.compact(3, broken, every=1)
    assert table.base() == -1 and table.read().count() == 6
    assert table.compact(3, every=1) and not table.compact(3, every=1)
    assert (table.base(), table.batches(), table.read().count()) == (2, [], 6)
    table.write(spark.range(99, 100), 2)                   # a late replay of a merged batch is not read twice
    assert table.read().count() == 6


def test_cycles_of_a_stream_equal_the_same_cycles_by_hand_and_replay(spark):
    from riskfold.operators import maintenance
    from riskfold.plans import stream_plans
    from riskfold.sources.versioned import VersionedStore
    docs = read_table(spark, SF_SMALL, "documents")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 10 != 3, F.col("source")))  # no ticker: dead letters
    root = jobs.stream_root(spark, "t-cycle")
    parts = [docs.where(F.col("doc_id") % 2 == k) for k in range(2)]
    stores = [VersionedStore(spark, f"{root}/{n}") for n in ("stream", "hand")]
    for store in stores:
        maintenance.create_tables(store)
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{root}/landed")
        stream = jobs.file_stream(spark, f"{root}/landed", docs.schema)
        for _ in range(2):                                 # goes on where it ended
            jobs.news_cycle_stream(spark, stream, stores[0], lambda df, b: stream_plans.news_cycle(stores[0], df, b), root)
        stream_plans.news_cycle(stores[1], part, str(k))
        stream_plans.news_cycle(stores[1], part, str(k))   # replayed: nothing changes
    for name in ("articles", "index", "dead"):
        a, b = (sorted(map(repr, s.read(name).collect())) for s in stores)
        assert a == b and a, name
    ids = {r.id for r in stores[0].read("articles").collect()}
    assert {r.id for r in stores[0].read("index").collect()} <= ids
    assert {r.src_order for r in stores[0].read("dead").collect()} == {r.doc_id for r in docs.where("source is null").collect()}
    assert all((r.summary or "").strip() for r in stores[0].read("articles").where("summary is not null").collect())


def test_link_refresh_changes_both_tables_once(spark, tmp_path):
    from riskfold.operators import maintenance
    from riskfold.sources.versioned import VersionedStore
    store = VersionedStore(spark, str(tmp_path / "s"))
    maintenance.create_link_tables(store)
    store.commit({"links": spark.createDataFrame([("t", "old", "h", "a"), ("t", "empty", None, None), ("u", "keep", "h", "a")],
                                                 "ticker string, link string, headline string, article string"),
                  "blocked": spark.createDataFrame([("t", "bad", 0)], "ticker string, link string, src_order long")})
    found = spark.createDataFrame([("t", "old", "x", "x", None, None, 1), ("t", "bad", "x", "x", None, None, 2), ("t", "new", "h2", "a2", None, None, 3),
                                   ("t", "new", "later", "later", None, None, 4), ("t", "prem", "h", "PREMIUM", None, None, 5),
                                   ("t", "empty", "now", "text", None, None, 6), ("v", "blank", "h", " ", None, None, 7)],
                                  "ticker string, link string, headline string, article string, byline string, publisher string, src_order long")
    for _ in range(2):
        maintenance.refresh_links(store, found, batch="7")
    assert {(r.ticker, r.link, r.headline) for r in store.read("links").collect()} == \
        {("t", "old", "h"), ("u", "keep", "h"), ("t", "new", "h2"), ("t", "empty", "now")}
    assert {(r.ticker, r.link) for r in store.read("blocked").collect()} == {("t", "bad"), ("t", "prem")}
    assert store.read("links").count() == 4 and store.read("blocked").count() == 2


def test_landed_files_are_no_larger_than_splits(spark):
    df = spark.range(600).repartition(10)
    each = jobs.files_per_batch(df, 4)
    root = jobs.stream_root(spark, "t-splits")
    stream = jobs.file_stream(spark, jobs.land(df, "id", 4 * each, f"{root}/landed"), df.schema, each)
    seen = {}
    jobs.run_available(stream.writeStream.foreachBatch(lambda b, n: seen.update({n: b.count()})), f"{root}/checkpoint")
    assert each == 3 and len(seen) == 4 and sum(seen.values()) == 600
