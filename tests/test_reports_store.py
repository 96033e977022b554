"""Live-or-stored news, edited positions, stored scores, newer fundamentals."""

import datetime as dt

from riskfold.operators import fundamentals as FU
from riskfold.operators import news, portfolio
from riskfold.sources import files

DAY = dt.datetime(2024, 2, 1)


def test_live_or_stored_per_ticker(spark):
    live = spark.createDataFrame([("A", "second", 2), ("A", "first", 1), ("A", " ", 0), ("B", None, 3), ("D", "", 4), ("E", "only live", 5)],
                                 "ticker string, headline string, n long")
    stored = spark.createDataFrame(
        [(str(i), "h%d" % i, t, DAY + dt.timedelta(i) if i % 2 else None, s) for i, (t, s) in enumerate(
            [("A", "x"), ("B", "x"), ("B", "x"), ("B", "x"), ("B", "x"), ("C", " "), ("C", None), ("D", "x")])],
        "id string, headline string, ticker string, pubdate timestamp_ntz, summary string")
    got = {}
    for r in news.live_or_stored(live, stored, "n", n=2).orderBy("ticker", "rank").collect():
        got.setdefault(r.ticker, []).append((r.origin, r.headline))
    assert got["A"] == [("live", "first"), ("live", "second")] and got["E"] == [("live", "only live")]
    assert [o for o, _ in got["B"]] == ["stored"] * 2 and got["D"] == [("stored", "h7")]
    assert "C" not in got                      # neither a live headline nor a summary
    assert news.live_or_stored(live.limit(0), stored.limit(0), "n").count() == 0


def test_edit_positions_equals_upsert_then_remove(spark):
    schema = "portfolio_id long, ticker string, quantity double"
    current = spark.createDataFrame([(p, t, float(10 * p + i)) for p in (1, 2, 3) for i, t in enumerate("ABC")] + [(4, "A", None)], schema)
    changes = spark.createDataFrame([(1, "A", 99.0), (2, "Z", 5.0), (3, "B", None), (5, "A", 1.0), (3, "C", 7.0)], schema)
    removals = spark.createDataFrame([(1, "B"), (3, "C"), (9, "A"), (2, "Z")], "portfolio_id long, ticker string")
    plain = portfolio.remove_positions(portfolio.upsert_positions(current, changes), removals)
    once = portfolio.edit_positions(current, changes, removals)
    assert once.schema == plain.schema

    def rows(df):
        return sorted(map(tuple, df.collect()), key=repr)
    assert rows(once) == rows(plain)
    assert rows(portfolio.edit_positions(current, changes.limit(0), removals.limit(0))) == rows(current)


def test_stored_scores_are_optional(spark, tmp_path):
    assert files.load_scores(spark, str(tmp_path / "absent")).collect() == []
    (tmp_path / "scores.csv").write_text('﻿investor,srisk,category\n"Doe, Kim",0.25,SAFE\nLee,n/a,\n', encoding="utf-8")
    rows = files.load_scores(spark, str(tmp_path / "scores.csv")).collect()
    assert sorted((r.investor, r.category, r.srisk) for r in rows) == [("Doe, Kim", "SAFE", 0.25), ("Lee", None, None)]


def test_newer_fundamentals_override_stored_ones_by_column(spark):
    schema = "Ticker string, Sector string, revenue double"
    live = spark.createDataFrame([("A", "new", None), ("B", None, 2.0), ("C", None, None)], schema)
    stored = spark.createDataFrame([("A", "old", 1.0), ("B", "old", 9.0), ("D", None, 4.0)], schema)
    assert sorted(map(tuple, FU.override_stored(live, stored).collect())) == [
        ("A", "new", 1.0), ("B", "old", 2.0), ("C", None, None), ("D", None, 4.0)]
    assert sorted(r.Ticker for r in FU.override_stored(live, stored.limit(0)).collect()) == ["A", "B", "C"]
