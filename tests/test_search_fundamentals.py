"""Symbol search vs brute-force scoring; provider-record assembly rules."""

from pyspark.sql import functions as F

from riskfold.operators import fundamentals as FU
from riskfold.operators import search


def _score(ticker, sector, q):
    t, s = ticker.lower(), (sector or "").lower()
    if t == q:
        return 0
    if t.startswith(q):
        return 1
    if q in t:
        return 2
    if q in s:
        return 3
    return 99


def test_rank_matches_equals_brute_force(spark):
    opts = [("AAPL", "Information Technology"), ("AAP", "Consumer"), ("MAPL", "Energy"), ("BRK-B", "Financials"),
            ("TECH", "Health Care"), ("A", None)]
    queries = [(1, "aap"), (2, "a"), (3, " tech "), (4, "zzz"), (5, "Apl"), (6, "aap")]
    got = {}
    odf = spark.createDataFrame(opts, "ticker string, sector string")
    qdf = spark.createDataFrame(queries, "query_id long, query string")
    for r in search.rank_matches(qdf, odf, k=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.ticker, r.score))
    for qid, text in queries:
        q = text.strip().lower()
        scored = sorted((s, t) for t, sec in opts if (s := _score(t, sec, q)) < 99)[:3]
        want = [(i + 1, t, s) for i, (s, t) in enumerate(scored)]
        assert sorted(got.get(qid, [])) == want


def test_record_assembly_rules(spark):
    rows = [
        ("X", "profile", '{"sector": "Tech", "industry": "Chips", "sharesOutstanding": 10}'),
        ("X", "ratios", '[{"netProfitMarginTTM": 27.1, "currentRatioTTM": 1.5}]'),
        ("X", "metrics", '{"revenuePerShareTTM": 0, "bookValuePerShareTTM": null}'),
        ("X", "income", '[{"revenue": 100.0, "weightedAverageShsOutDil": 4}, {"revenue": 999.0}]'),
        ("X", "balance", '[{"totalStockholdersEquity": 20.0, "totalDebt": 5.0}]'),
        ("X", "cashflow", '[]'),
        ("X", "growth", '{"Error Message": "limit"}'),
        ("Y", "profile", '[]'), ("Y", "ratios", '[]'), ("Y", "metrics", 'not json'),
    ]
    rec = spark.createDataFrame(rows, "ticker string, endpoint string, payload string")
    out = {r.Ticker: r for r in FU.assemble(FU.wide_records(rec)).collect()}
    x = out["X"].asDict()
    assert x["Sector"] == "Tech" and x["_error"] is None
    assert abs(x["Profit Margin"] - 0.271) < 1e-12            # |x| > 3 -> percent
    assert x["Revenue (ttm)"] == 100.0                          # first element of the list
    assert x["Revenue Per Share (ttm)"] == 25.0                 # picked 0 counts as missing -> 100 / 4
    assert x["Book Value Per Share (mrq)"] == 5.0               # JSON null -> derived 20 / 4
    assert x["Total Debt/Equity (mrq)"] == 0.25                 # no ratio -> 5 / 20
    assert x["Quarterly Revenue Growth (yoy)"] is None          # provider error object -> empty
    assert out["Y"]["_error"] is not None                       # every record empty -> failure
