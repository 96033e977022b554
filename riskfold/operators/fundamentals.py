"""Fundamentals consolidation (S11, S16, S17, J7, J10, M4, M5, P13, P14, U4,
K9, K10, R13).

Provider records arrive as long rows ``(ticker, endpoint, payload)`` where
a payload is a JSON object or a JSON list of objects.  One pivot on ticker
(bounded: seven endpoints per ticker) gives the wide record row; every
output column is then a ``coalesce`` over (record, key) pairs in the
reference's priority order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskfold import schemas
from riskfold.functions import numbers as N
from riskfold.functions import text as X

ENDPOINTS = ("profile", "ratios", "metrics", "income", "balance", "cashflow", "growth")

# Fixed values: (output column, record sets in priority order, keys in priority
# order, scale fix for ratios, fallback) of the reference's record assembly.
SHARES = (("income", "balance", "metrics", "profile"),
          ("weightedAverageShsOutDil", "weightedAverageShsOut", "sharesOutstanding", "weightedAverageSharesDiluted"))
REVENUE = (("income", "metrics"), ("revenue", "revenueTTM"))
TOTAL_CASH = (("balance", "metrics"), ("cashAndCashEquivalents", "cashAndShortTermInvestments", "cashAndCashEquivalentsTTM"))
TOTAL_DEBT = (("balance", "metrics"), ("totalDebt", "totalDebtTTM"))
TOTAL_EQUITY = (("balance",), ("totalStockholdersEquity", "totalEquity", "totalStockholdersEquityAndTotalLiabilities"))
FIELDS = (
    ("Profit Margin", ("ratios", "metrics"), ("netProfitMarginTTM", "netProfitMargin", "profitMarginTTM"), True, None),
    ("Operating Margin (ttm)", ("ratios", "metrics"), ("operatingProfitMarginTTM", "operatingProfitMargin"), True, None),
    ("Return on Assets(ROA) (ttm)", ("ratios", "metrics"), ("returnOnAssetsTTM", "returnOnAssets"), True, None),
    ("Return on Equity(ROE) (ttm)", ("ratios", "metrics"), ("returnOnEquityTTM", "returnOnEquity"), True, None),
    ("Revenue (ttm)", REVENUE[0], REVENUE[1], False, None),
    ("Revenue Per Share (ttm)", ("metrics",), ("revenuePerShareTTM", "revenuePerShare"), False, ("revenue", "shares")),
    ("Quarterly Revenue Growth (yoy)", ("growth",), ("revenueGrowth", "growthRevenue"), True, None),
    ("Gross Profit (ttm)", ("income",), ("grossProfit", "grossProfitTTM"), False, None),
    ("EBITDA", ("income", "metrics"), ("ebitda", "ebitdaTTM"), False, None),
    ("Net Income Avi to Common (ttm)", ("income",), ("netIncome", "netIncomeCommonStockholders", "netIncomeTTM"), False, None),
    ("Diluted EPS (ttm)", ("income", "metrics"), ("epsdiluted", "epsDiluted", "netIncomePerShareTTM"), False, None),
    ("Quarterly Earnings Growth (yoy)", ("growth",), ("netIncomeGrowth", "growthNetIncome"), True, None),
    ("Total Cash (mrq)", TOTAL_CASH[0], TOTAL_CASH[1], False, None),
    ("Total Cash Per Share (mrq)", ("metrics",), ("cashPerShareTTM", "cashPerShare"), False, ("cash", "shares")),
    ("Total Debt (mrq)", TOTAL_DEBT[0], TOTAL_DEBT[1], False, None),
    ("Total Debt/Equity (mrq)", ("ratios", "metrics"), ("debtEquityRatioTTM", "debtToEquityTTM", "debtToEquity"), False,
     ("debt", "equity")),
    ("Current Ratio (mrq)", ("ratios", "metrics"), ("currentRatioTTM", "currentRatio"), False, None),
    ("Book Value Per Share (mrq)", ("metrics",), ("bookValuePerShareTTM", "bookValuePerShare"), False, ("equity", "shares")),
    ("Operating Cash Flow (ttm)", ("cashflow",), ("netCashProvidedByOperatingActivities", "operatingCashFlow",
                                                  "operatingCashFlowTTM"), False, None),
    ("Levered Free Cash Flow (ttm)", ("cashflow", "metrics", "ratios"), ("freeCashFlow", "freeCashFlowTTM",
                                                                        "freeCashFlowPerShareTTM"), False, None),
)
ERROR_KEY = "Error Message"


def parse_record(payload: Column) -> Column:
    """A JSON object, or the first object of a JSON list, as
    map<string,string>; an empty list, non-JSON text or a provider error
    object gives an empty map."""
    as_list = F.from_json(payload, "array<map<string,string>>")
    as_obj = F.from_json(payload, "map<string,string>")
    rec = F.coalesce(F.get(as_list, 0), F.when(F.trim(payload).startswith("{"), as_obj))
    empty = F.create_map().cast("map<string,string>")
    rec = F.coalesce(rec, empty)
    return F.when(F.map_contains_key(rec, ERROR_KEY), empty).otherwise(rec)


def wide_records(records: DataFrame, ticker: str = "ticker") -> DataFrame:
    """One row per ticker with one record map per endpoint (pivot)."""
    r = records.select(ticker, "endpoint", parse_record(F.col("payload")).alias("rec"))
    w = r.groupBy(ticker).pivot("endpoint", list(ENDPOINTS)).agg(F.first("rec"))
    empty = F.create_map().cast("map<string,string>")
    return w.select(ticker, *[F.coalesce(F.col(e), empty).alias(e) for e in ENDPOINTS])


def pick(records, keys) -> Column:
    """M4: first non-null value over records x keys, record-major order."""
    return F.coalesce(*[F.col(r).getItem(k).try_cast("double") for r in records for k in keys])


def assemble(wide: DataFrame, ticker: str = "ticker") -> DataFrame:
    """J10 + M2 + M3 + M4 + M5: the 23-column fundamentals row; tickers whose
    seven records are all empty become failure rows (``_error``)."""
    # shared fallback inputs, computed once per row in their own projection
    wide = wide.select("*", pick(*SHARES).alias("_shares"), pick(*REVENUE).alias("_revenue"),
                       pick(*TOTAL_CASH).alias("_cash"), pick(*TOTAL_DEBT).alias("_debt"),
                       pick(*TOTAL_EQUITY).alias("_equity"))
    base = {k: F.col(f"_{k}") for k in ("shares", "revenue", "cash", "debt", "equity")}
    cols = [F.col(ticker).alias("Ticker"),
            F.col("profile").getItem("sector").alias("Sector"),
            F.col("profile").getItem("industry").alias("Industry")]
    for name, recs, keys, ratio, fallback in FIELDS:
        v = pick(recs, keys)
        if ratio:
            v = N.ratio_scale(v)
        if fallback:
            num, den = fallback
            v = N.pick_or_derive(v, N.safe_div(base[num], base[den]))
        cols.append(v.alias(name))
    any_rec = reduce(lambda a, b: a | b, [F.size(F.col(e)) > 0 for e in ENDPOINTS])
    err = F.when(~any_rec, F.lit("all provider endpoints returned no usable data"))
    return wide.select(*cols, err.alias("_error"))


def split_failures(assembled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K9: (good rows conformed to the fundamentals schema, failure rows)."""
    good = schemas.conform(assembled.where(F.col("_error").isNull()), schemas.FUNDAMENTALS_SCHEMA)
    bad = assembled.where(F.col("_error").isNotNull()).select("Ticker", "_error")
    return good, bad


def backfill(refreshed: DataFrame, stored: DataFrame, key: str = "Ticker") -> DataFrame:
    """J7 + U2 + U4 + W9 + T5: refreshed rows win; stored rows whose key was
    not refreshed are kept; one row per key; sorted by key."""
    from riskfold.operators.news import keep_first
    fresh = refreshed.withColumn("_src", F.lit(0))
    old = stored.join(refreshed.select(key), key, "left_anti").withColumn("_src", F.lit(1))
    u = fresh.unionByName(old, allowMissingColumns=True).withColumn("_o", F.monotonically_increasing_id())
    return keep_first(u, key, ["_src", "_o"]).drop("_src", "_o")


def override_stored(live: DataFrame, stored: DataFrame, key: str = "Ticker") -> DataFrame:
    """Per key and column the newer value, else the stored one; keys of
    either side stay.  Each side has a key at most once, so one union and one
    aggregation (the key's single non-null value of each side) do the join."""
    columns = [c for c in live.columns if c != key]
    both = live.select(key, F.struct(*columns).alias("_live")).unionByName(
        stored.select(key, F.struct(*columns).alias("_stored")), allowMissingColumns=True)
    one = both.groupBy(key).agg(F.any_value("_live", F.lit(True)).alias("_live"), F.any_value("_stored", F.lit(True)).alias("_stored"))
    return one.select(key, *[F.coalesce(F.col("_live").getField(c), F.col("_stored").getField(c)).alias(c) for c in columns])


def field_map(snapshot: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """P13 + P14: rename-map projection of a snapshot record; nested
    (object / list) values become null."""
    return snapshot.select(*[X.nested_to_null(F.col(src)).alias(dst) for dst, src in mapping.items()])


def tickers_from_index(constituents: DataFrame, body: str = "body", key: str = "symbol") -> DataFrame:
    """S16 + F3 + A19: symbols of an index-constituent JSON list, non-empty,
    normalised, first occurrence kept in list order."""
    arr = F.from_json(F.col(body), f"array<struct<{key}: string>>")
    x = constituents.select(F.posexplode(arr).alias("pos", "r")).select(
        "pos", X.symbol_norm(F.col(f"r.{key}")).alias("ticker"))
    x = x.where(F.col("ticker").isNotNull() & (F.col("ticker") != ""))
    from riskfold.operators.news import keep_first
    return keep_first(x, "ticker", "pos")
