"""Golden values recorded by the reference (typed in as literals)."""

import json

from pyspark.sql import functions as F

from riskfold.operators import portfolio, risk

# Universe quartiles (q1, median, q3) of the reference's 515-row universe.
Q_SIGMA = (0.2329415, 0.282703, 0.349729)
Q_MDD = (0.2649095, 0.36161, 0.4692515)
Q_BETA = (0.5525835, 0.873965, 1.1822575)

UNIVERSE = [("AAPL", "Information Technology", 0.267761, -0.34711, 1.230503),
            ("AMZN", "Consumer Discretionary", 0.330355, -0.324574, 1.491953),
            ("MSFT", "Information Technology", 0.239502, -0.252404, 1.091447),
            ("NVDA", "Information Technology", 0.510038, -0.411434, 2.174863),
            ("TSLA", "Consumer Discretionary", 0.616436, -0.575984, 2.242418)]


def _quartiles():
    arr = lambda q: F.array(*[F.lit(x) for x in q])
    return F.struct(arr(Q_SIGMA).alias("sigma"), arr(Q_MDD).alias("mdd"), arr(Q_BETA).alias("beta"))


def test_cli_example_portfolio(spark):
    u = spark.createDataFrame(UNIVERSE, "ticker string, sector string, sigma double, mdd double, beta double")
    w = spark.createDataFrame([(1, "AAPL", 0.3), (1, "MSFT", 0.25), (1, "NVDA", 0.15), (1, "TSLA", 0.1),
                               (1, "AMZN", 0.2)], "portfolio_id long, ticker string, weight double")
    r = risk.score_portfolios(w, u, quartiles=_quartiles()).collect()[0]
    assert abs(r.srisk - 0.3933) < 6e-4
    assert abs(r.hhi - 0.58) < 1e-9
    assert r.category == "NEUTRAL"


def test_recorded_single_result(spark):
    # Sigma_p, MDD_p, Beta_p and Srisk of the recorded single-portfolio result.
    df = spark.createDataFrame([(0.5486303817701453, -0.44988553632760897, 2.02314478996037)],
                               "s double, m double, b double")
    q = _quartiles()
    score = (0.35 * risk.robust_z(F.col("s"), q.getField("sigma"))
             - 0.25 * risk.robust_z(F.abs(F.col("m")), q.getField("mdd"))
             + 0.20 * risk.robust_z(F.col("b"), q.getField("beta")))
    row = df.select(score.alias("srisk"), risk.category(score).alias("cat")).collect()[0]
    assert abs(row.srisk - 1.053964837940801) < 1e-4
    assert row.cat == "AGGRESSIVE"


# Further rows of that universe, named portfolios and the results recorded for them.
MORE = [("CMG", "Consumer Discretionary", 0.323219, -0.586803, 0.914716),
        ("COIN", "Financials", 0.837425, -0.615873, 2.610449),
        ("GOOG", "Communication Services", 0.303522, -0.301735, 1.201491),
        ("HLT", "Consumer Discretionary", 0.226291, -0.270296, 0.943766),
        ("KO", "Consumer Staples", 0.148469, -0.176091, 0.190839),
        ("LMT", "Industrials", 0.210673, -0.341258, 0.191596),
        ("LOW", "Consumer Discretionary", 0.23996, -0.262921, 0.830639),
        ("META", "Communication Services", 0.385677, -0.360499, 1.542003),
        ("OXY", "Energy", 0.303491, -0.547737, 0.847956),
        ("PLTR", "Information Technology", 0.653981, -0.439165, 2.248157),
        ("SHOP", "Unknown", 0.576112, -0.463223, 2.275902),
        ("XOM", "Energy", 0.23144, -0.202968, 0.505209)]
INVESTORS = {
    "Cathie Wood": {"TSLA": 0.10, "NVDA": 0.06, "ROKU": 0.05, "PATH": 0.05, "CRSP": 0.05, "SQ": 0.04, "SHOP": 0.04, "COIN": 0.05,
                    "TDOC": 0.04, "PLTR": 0.03},
    "George Soros": {"SPY": 0.15, "TLT": 0.10, "AAPL": 0.08, "MSFT": 0.07, "NVDA": 0.05, "GOOG": 0.05, "AMZN": 0.05, "GLD": 0.10,
                     "META": 0.05, "BABA": 0.10},
    "Michael Burry": {"XLE": 0.15, "XLF": 0.10, "TSLA": 0.05, "SPY": 0.20, "GLD": 0.10, "XLB": 0.10, "TLT": 0.10, "XLP": 0.10, "OXY": 0.10},
    "Bill Ackman": {"CMG": 0.15, "HLT": 0.15, "QSR": 0.15, "LMT": 0.10, "LOW": 0.10, "SPY": 0.10, "GOOG": 0.10, "HHC": 0.15},
    "Ray Dalio": {"SPY": 0.20, "GLD": 0.10, "XOM": 0.10, "BABA": 0.05, "TLT": 0.10, "KO": 0.05, "VWO": 0.10, "FXI": 0.05, "IVV": 0.10,
                  "XLK": 0.15},
}
RECORDED = [("Cathie Wood", 1.3073, "AGGRESSIVE", 0.6314, -0.5171, 2.2991, 0.0935),
            ("George Soros", 0.3457, "NEUTRAL", 0.3276, -0.3296, 1.4153, 0.255),
            ("Michael Burry", 0.2751, "SAFE", 0.4078, -0.5572, 1.3128, 0.735),
            ("Bill Ackman", -0.0756, "SAFE", 0.2631, -0.3653, 0.8352, 0.34),
            ("Ray Dalio", -0.1819, "SAFE", 0.2038, -0.194, 0.4004, 0.735)]


def test_recorded_investors(spark):
    """S15 -> A14: five of the named portfolios, from their JSON document to the
    recorded results; most tickers of some are not in the universe."""
    u = spark.createDataFrame(UNIVERSE + MORE, "ticker string, sector string, sigma double, mdd double, beta double")
    docs = spark.createDataFrame([(json.dumps(INVESTORS),)], "doc string")
    scored = risk.score_portfolios(portfolio.named_portfolios(docs), u, pid="investor", quartiles=_quartiles())
    rows = {r.investor: r for r in scored.collect()}
    assert set(rows) == set(INVESTORS)
    for name, srisk, category, sigma, mdd, beta, hhi in RECORDED:
        r = rows[name]
        assert r.category == category
        for got, want in ((r.srisk, srisk), (r.sigma_p, sigma), (r.mdd_p, mdd), (r.beta_p, beta), (r.hhi, hhi)):
            assert abs(got - want) < 1.01e-4, (name, got, want)


def test_unmatched_tickers_count_in_hhi_and_error_row(spark):
    u = spark.createDataFrame(UNIVERSE, "ticker string, sector string, sigma double, mdd double, beta double")
    w = spark.createDataFrame([(1, "AAPL", 0.5), (1, "ZZZZ", 0.5), (2, "NOPE", 1.0)],
                              "portfolio_id long, ticker string, weight double")
    rows = {r.portfolio_id: r for r in risk.score_portfolios(w, u, quartiles=_quartiles()).collect()}
    # weighted metrics use matched weight only; HHI counts the unmatched 'Unknown' sector
    assert abs(rows[1].sigma_p - 0.2678) < 1e-4
    assert abs(rows[1].hhi - 0.5) < 1e-9
    assert rows[2].srisk is None and rows[2].error is not None


def test_category_thresholds(spark):
    df = spark.createDataFrame([(0.3299,), (0.33,), (0.6599,), (0.66,), (None,)], "x double")
    cats = [r.c for r in df.select(risk.category(F.col("x")).alias("c")).collect()]
    assert cats == ["SAFE", "NEUTRAL", "NEUTRAL", "AGGRESSIVE", "AGGRESSIVE"]


def test_exact_quantiles_match_percentile(spark):
    import numpy as np
    from riskfold.operators.stats import exact_quantiles
    rng = np.random.default_rng(11)
    vals = list(rng.normal(size=3000)) + [0.5] * 1500 + list(rng.integers(0, 5, 700).astype(float))
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    probs = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
    want = df.select(F.percentile("x", F.array(*[F.lit(p) for p in probs])).alias("q")).first().q
    got = exact_quantiles(df, "x", probs, ranges=7)
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, want))
    assert exact_quantiles(df.where("x > 1e9"), "x", probs) == [None] * len(probs)


def test_exact_quantiles_multi_match_percentile(spark):
    import numpy as np
    from riskfold.operators.stats import exact_quantiles_multi
    rng = np.random.default_rng(12)
    rows = [(float(a), float(b)) for a, b in zip(rng.normal(size=2500), rng.integers(0, 7, 2500))]
    df = spark.createDataFrame(rows, "a double, b double")
    probs = (0.1, 0.25, 0.5, 0.75)
    got = exact_quantiles_multi(df, ("a", "b"), probs, ranges=5)
    for c in ("a", "b"):
        want = df.select(F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias("q")).first().q
        assert all(abs(x - y) < 1e-12 for x, y in zip(got[c], want))
