"""Registered queries: smoke on sf0.001, invariants, and a sample of oracle
comparisons on sf0.01 (the full comparison runs in tools/check_oracles.py)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_ORACLE, SF_SMALL
from riskfold.sources.tables import TABLES


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"portfolio_id", "srisk", "category"} <= set(df.columns)


def test_every_query_has_a_callable(spark):
    qs, orc = entry.queries(), entry.oracle_sql()
    assert len(qs) >= 80
    assert set(orc) <= set(qs)


def test_weights_sum_to_one_and_drawdown_non_positive(spark):
    qs = entry.queries()
    w = qs["q_pie_cumsum"](spark, SF_SMALL)
    ends = w.groupBy("portfolio_id").agg({"slice_end": "max"}).collect()
    assert all(abs(r[1] - 1.0) < 1e-5 for r in ends)
    dd = qs["q_drawdown_price"](spark, SF_SMALL).where("drawdown > 0").count()
    assert dd == 0
    hhi = qs["q_sector_hhi"](spark, SF_SMALL).where("hhi > 1.000001").count()
    assert hhi == 0


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


SAMPLE = ["q_srisk_v1", "q_ticker_metrics_a", "q_preprocess", "q_upsert_ignore", "q_dup_pairs",
          "q_topk_search", "q_page_extract", "q_ticker_search"]


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle_sample(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_ORACLE}/{t}.parquet')")
    sdf = entry.queries()[name](spark, SF_ORACLE)
    cur = con.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(ocols)
    so = sorted(range(len(sdf.columns)), key=lambda i: sdf.columns[i])
    oo = sorted(range(len(ocols)), key=lambda i: ocols[i])
    a = sorted((tuple(_norm(r[i]) for i in so) for r in sdf.collect()), key=repr)
    b = sorted((tuple(_norm(r[i]) for i in oo) for r in cur.fetchall()), key=repr)
    assert a == b
