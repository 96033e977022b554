"""Market-metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfold.operators import market
from riskfold.plans import bindings as B
from riskfold.plans import sql_fragments as S
from riskfold.plans.catalog import register


def _prices(spark, sf):
    return market.select_price(B.prices(spark, sf))


@register("q_log_returns", sql=f"""
WITH {S.PRICES}
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, round(price, 6) AS price,
       round(ln(price / lag(price) OVER (PARTITION BY ticker ORDER BY ts)), 9) AS ret
FROM prices""")
def q_log_returns(spark, sf):
    """W1 + S12: log returns of every security (adjusted close else close)."""
    r = market.log_returns(_prices(spark, sf))
    return r.select("ticker", F.date_format("ts", "yyyy-MM-dd").alias("ts"),
                    F.round("price", 6).alias("price"), F.round("ret", 9).alias("ret"))


@register("q_simple_returns", sql=f"""
WITH {S.PRICES}
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts,
       round(price / lag(price) OVER (PARTITION BY ticker ORDER BY ts) - 1, 9) AS ret
FROM prices""")
def q_simple_returns(spark, sf):
    """Simple returns."""
    r = market.simple_returns(_prices(spark, sf))
    return r.select("ticker", F.date_format("ts", "yyyy-MM-dd").alias("ts"), F.round("ret", 9).alias("ret"))


@register("q_drawdown_log", sql=f"""
WITH {S.UNIVERSE}
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, round(cum, 6) AS cum_growth, round(drawdown, 6) AS drawdown
FROM dd2""")
def q_drawdown_log(spark, sf):
    """W3-W5 variant A: cumulative product of (1+r), running peak, drawdown."""
    r = market.log_returns(_prices(spark, sf)).where(F.col("ret").isNotNull())
    w = market._w("ticker", "ts").rowsBetween(market.UNBOUNDED, 0)
    r = r.withColumn("cum_growth", F.product(1.0 + F.col("ret")).over(w))
    r = market.drawdown_from_returns(r)
    return r.select("ticker", F.date_format("ts", "yyyy-MM-dd").alias("ts"),
                    F.round("cum_growth", 6).alias("cum_growth"), F.round("drawdown", 6).alias("drawdown"))


@register("q_drawdown_price", sql=f"""
WITH {S.PRICES}
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts,
       round((price - max(price) OVER w) / max(price) OVER w, 9) AS drawdown
FROM prices
WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_drawdown_price(spark, sf):
    """W4-W5 variant B: drawdown on the price itself."""
    r = market.drawdown_from_prices(_prices(spark, sf))
    return r.select("ticker", F.date_format("ts", "yyyy-MM-dd").alias("ts"), F.round("drawdown", 9).alias("drawdown"))


@register("q_ticker_metrics_a", sql=f"""
WITH {S.UNIVERSE}
SELECT ticker, sector, sigma, mdd, beta FROM universe""")
def q_ticker_metrics_a(spark, sf):
    """A24 (A9-A12, J8, J14): sigma / MDD / beta / sector of every security."""
    return B.universe(spark, sf)


@register("q_ticker_metrics_b", sql=f"""
WITH {S.PRICES},
n AS (SELECT count(DISTINCT ticker) AS n FROM prices),
keep AS (SELECT ts FROM prices GROUP BY ts HAVING count(DISTINCT ticker) = (SELECT n FROM n)),
p AS (SELECT * FROM prices WHERE ts IN (SELECT ts FROM keep)),
bench AS (SELECT ts, avg(price) AS price FROM p GROUP BY ts),
br AS (SELECT ts, price / lag(price) OVER (ORDER BY ts) - 1 AS bench_ret FROM bench),
r AS (SELECT ticker, ts, price,
             price / lag(price) OVER (PARTITION BY ticker ORDER BY ts) - 1 AS ret,
             (price - max(price) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
               / max(price) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dd
      FROM p)
SELECT r.ticker, round(stddev_samp(ret) * sqrt(12), 6) AS sigma, round(min(dd), 6) AS mdd,
       round(regr_slope(ret, bench_ret), 6) AS beta
FROM r LEFT JOIN br USING (ts) GROUP BY r.ticker""")
def q_ticker_metrics_b(spark, sf):
    """A25 + A26: variant B on complete-case periods."""
    return market.ticker_metrics_b(_prices(spark, sf), periods_per_year=B.PERIODS_PER_YEAR)


@register("q_benchmark_returns", sql=f"""
WITH {S.PRICES},
bench AS (SELECT ts, avg(price) AS price FROM prices GROUP BY ts)
SELECT strftime(ts, '%Y-%m-%d') AS ts, round(price, 6) AS price,
       round(ln(price / lag(price) OVER (ORDER BY ts)), 9) AS bench_ret
FROM bench""")
def q_benchmark_returns(spark, sf):
    """J8 input: the equal-weight benchmark series and its log returns."""
    b = market.benchmark_series(_prices(spark, sf))
    r = market._bench_returns(b, "ts", "log")
    return (b.join(r, "ts", "left")
            .select(F.date_format("ts", "yyyy-MM-dd").alias("ts"), F.round("price", 6).alias("price"),
                    F.round("bench_ret", 9).alias("bench_ret")))
