"""Fundamentals queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfold import schemas
from riskfold.operators import fundamentals as FU
from riskfold.plans import bindings as B
from riskfold.plans.catalog import register
from riskfold.sources.tables import read_table


def provider_aggregates(spark, sf):
    li = read_table(spark, sf, "lineitem")
    yr = F.year("l_shipdate")
    a = li.groupBy("l_suppkey").agg(
        F.sum("l_extendedprice").alias("rev"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("tax"),
        F.sum("l_quantity").alias("qty"), F.count("*").alias("lines"),
        F.countDistinct("l_orderkey").alias("orders"),
        F.sum(F.when(yr == 1997, F.col("l_extendedprice"))).alias("rev97"),
        F.sum(F.when(yr == 1996, F.col("l_extendedprice"))).alias("rev96"))
    s = read_table(spark, sf, "supplier")
    n = read_table(spark, sf, "nation")
    r = read_table(spark, sf, "region")
    geo = F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name"))
    return (s.join(a, s.s_suppkey == a.l_suppkey, "left").join(geo, s.s_nationkey == geo.n_nationkey, "left")
            .select(B.symbol("s_suppkey").alias("ticker"), "s_acctbal", "rev", "net", "tax", "qty", "lines",
                    "orders", "rev97", "rev96", "n_name", "r_name"))


def provider_records(spark, sf):
    """Landed provider payloads (ticker, endpoint, payload JSON text), written
    from supplier and lineitem aggregates.  Suppliers with a negative
    balance answer every endpoint with an empty list; the 'metrics'
    endpoint is empty below a 5000 balance; odd nation keys answer the
    profile endpoint with a provider error object."""
    a = provider_aggregates(spark, sf)
    neg = F.col("s_acctbal") < 0
    j = F.to_json
    prof = F.when(F.col("n_name").isin("ALGERIA", "BRAZIL", "CANADA"),
                  F.lit('{"Error Message": "limit reached"}')).otherwise(
        j(F.struct(F.col("n_name").alias("sector"), F.col("r_name").alias("industry"),
                   F.col("orders").alias("sharesOutstanding"))))
    ratios = j(F.array(F.struct(F.round(F.col("net") / F.col("rev") * 100.0, 4).alias("netProfitMarginTTM"),
                                F.round(F.col("qty") / F.col("lines"), 4).alias("currentRatioTTM"),
                                F.lit(None).cast("double").alias("debtEquityRatioTTM"))))
    metrics = F.when(F.col("s_acctbal") > 5000, j(F.struct(
        F.lit(0.0).alias("revenuePerShareTTM"),
        F.round(F.col("s_acctbal") / F.col("orders"), 4).alias("bookValuePerShareTTM"),
        F.round(F.col("tax") / F.col("net"), 6).alias("debtToEquityTTM")))).otherwise(F.lit("[]"))
    income = j(F.array(F.struct(F.col("rev").alias("revenue"), F.col("net").alias("grossProfit"),
                                (F.col("net") - F.col("tax")).alias("ebitda"),
                                (F.col("net") - 2 * F.col("tax")).alias("netIncome"),
                                F.round((F.col("net") - 2 * F.col("tax")) / F.col("orders"), 4).alias("epsdiluted"),
                                F.col("orders").alias("weightedAverageShsOutDil"))))
    balance = j(F.array(F.struct(F.col("s_acctbal").alias("cashAndCashEquivalents"), F.col("tax").alias("totalDebt"),
                                 (F.col("net") - F.col("tax")).alias("totalStockholdersEquity"))))
    cash = j(F.struct((F.col("net") - F.col("tax")).alias("operatingCashFlow"),
                      (F.col("net") - 3 * F.col("tax")).alias("freeCashFlow")))
    growth = j(F.array(F.struct(
        F.round((F.col("rev97") - F.col("rev96")) / F.col("rev96") * 100.0, 4).alias("revenueGrowth"),
        F.round((F.col("rev97") - F.col("rev96")) / F.col("rev96"), 4).alias("netIncomeGrowth"))))
    payloads = [("profile", prof), ("ratios", ratios), ("metrics", metrics), ("income", income),
                ("balance", balance), ("cashflow", cash), ("growth", growth)]
    arr = F.array(*[F.struct(F.lit(e).alias("endpoint"), F.when(neg, F.lit("[]")).otherwise(p).alias("payload"))
                    for e, p in payloads])
    return a.select("ticker", F.explode(arr).alias("r")).select("ticker", "r.endpoint", "r.payload")


def _rounded(df):
    return df.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) if t == "double" else F.col(f"`{c}`")
                       for c, t in df.dtypes])


_AGG = """
a AS (SELECT l_suppkey, sum(l_extendedprice) AS rev, sum(l_extendedprice * (1 - l_discount)) AS net,
             sum(l_extendedprice * l_tax) AS tax, sum(l_quantity) AS qty, count(*) AS lines,
             count(DISTINCT l_orderkey) AS orders,
             sum(CASE WHEN year(l_shipdate) = 1997 THEN l_extendedprice END) AS rev97,
             sum(CASE WHEN year(l_shipdate) = 1996 THEN l_extendedprice END) AS rev96
      FROM lineitem GROUP BY 1),
x AS (SELECT translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS ticker, s.s_acctbal, a.*, n.n_name, r.r_name,
             s.s_acctbal < 0 AS neg, n.n_name IN ('ALGERIA', 'BRAZIL', 'CANADA') AS prof_err
      FROM supplier s LEFT JOIN a ON a.l_suppkey = s.s_suppkey
      LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey),
f AS (SELECT ticker, neg,
  CASE WHEN neg OR prof_err THEN NULL ELSE n_name END AS sector,
  CASE WHEN neg OR prof_err THEN NULL ELSE r_name END AS industry,
  CASE WHEN neg THEN NULL ELSE round(net / rev * 100.0, 4) END AS pm_raw,
  CASE WHEN neg THEN NULL ELSE round(qty / lines, 4) END AS cur,
  CASE WHEN NOT neg AND s_acctbal > 5000 THEN round(s_acctbal / orders, 4) END AS bvps_m,
  CASE WHEN NOT neg AND s_acctbal > 5000 THEN round(tax / net, 6) END AS de_m,
  CASE WHEN NOT neg AND s_acctbal > 5000 THEN 0.0 END AS rps_m,
  CASE WHEN neg THEN NULL ELSE rev END AS revenue, CASE WHEN neg THEN NULL ELSE net END AS gross,
  CASE WHEN neg THEN NULL ELSE net - tax END AS ebitda, CASE WHEN neg THEN NULL ELSE net - 2 * tax END AS ni,
  CASE WHEN neg THEN NULL ELSE round((net - 2 * tax) / orders, 4) END AS eps,
  CASE WHEN neg THEN NULL ELSE CAST(orders AS DOUBLE) END AS shares,
  CASE WHEN neg THEN NULL ELSE s_acctbal END AS cash, CASE WHEN neg THEN NULL ELSE tax END AS debt,
  CASE WHEN neg THEN NULL ELSE net - tax END AS equity, CASE WHEN neg THEN NULL ELSE net - tax END AS ocf,
  CASE WHEN neg THEN NULL ELSE net - 3 * tax END AS fcf,
  CASE WHEN neg THEN NULL ELSE round((rev97 - rev96) / rev96 * 100.0, 4) END AS rg_raw,
  CASE WHEN neg THEN NULL ELSE round((rev97 - rev96) / rev96, 4) END AS eg_raw
  FROM x),
fund AS (SELECT ticker AS "Ticker", sector AS "Sector", industry AS "Industry",
  CASE WHEN abs(pm_raw) > 3 THEN pm_raw / 100.0 ELSE pm_raw END AS "Profit Margin",
  CAST(NULL AS DOUBLE) AS "Operating Margin (ttm)", CAST(NULL AS DOUBLE) AS "Return on Assets(ROA) (ttm)",
  CAST(NULL AS DOUBLE) AS "Return on Equity(ROE) (ttm)", revenue AS "Revenue (ttm)",
  coalesce(NULLIF(rps_m, 0), CASE WHEN shares IS NULL OR shares = 0 THEN NULL ELSE revenue / shares END) AS "Revenue Per Share (ttm)",
  CASE WHEN abs(rg_raw) > 3 THEN rg_raw / 100.0 ELSE rg_raw END AS "Quarterly Revenue Growth (yoy)",
  gross AS "Gross Profit (ttm)", ebitda AS "EBITDA", ni AS "Net Income Avi to Common (ttm)", eps AS "Diluted EPS (ttm)",
  CASE WHEN abs(eg_raw) > 3 THEN eg_raw / 100.0 ELSE eg_raw END AS "Quarterly Earnings Growth (yoy)",
  cash AS "Total Cash (mrq)",
  CASE WHEN shares IS NULL OR shares = 0 THEN NULL ELSE cash / shares END AS "Total Cash Per Share (mrq)",
  debt AS "Total Debt (mrq)",
  coalesce(NULLIF(de_m, 0), CASE WHEN equity IS NULL OR equity = 0 THEN NULL ELSE debt / equity END) AS "Total Debt/Equity (mrq)",
  cur AS "Current Ratio (mrq)",
  coalesce(NULLIF(bvps_m, 0), CASE WHEN shares IS NULL OR shares = 0 THEN NULL ELSE equity / shares END) AS "Book Value Per Share (mrq)",
  ocf AS "Operating Cash Flow (ttm)", fcf AS "Levered Free Cash Flow (ttm)", neg
  FROM f)"""

_NUMS = ", ".join(f'round("{c}", 6) AS "{c}"' for c in schemas.FUNDAMENTAL_NUMERIC)


@register("q_record_assemble", sql=f"""
WITH {_AGG}
SELECT "Ticker", "Sector", "Industry", {_NUMS},
       CASE WHEN neg THEN 'all provider endpoints returned no usable data' END AS _error
FROM fund""")
def q_record_assemble(spark, sf):
    """S11 + J10 + M2-M5: seven landed provider records per ticker -> one
    fundamentals row (failures flagged)."""
    return _rounded(FU.assemble(FU.wide_records(provider_records(spark, sf))))


@register("q_failures", sql=f"""
WITH {_AGG}
SELECT "Ticker", 'all provider endpoints returned no usable data' AS _error FROM fund WHERE neg""")
def q_failures(spark, sf):
    """K9 + E2: dead-letter rows of tickers with no usable record."""
    _, bad = FU.split_failures(FU.assemble(FU.wide_records(provider_records(spark, sf))))
    return bad


def stored_fundamentals(spark, sf, good=None):
    """A previous snapshot: refreshed values are scaled by 0.9 and the
    snapshot also holds header words and symbols no longer listed."""
    if good is None:
        good, _ = FU.split_failures(FU.assemble(FU.wide_records(provider_records(spark, sf))))
    old = good.select("Ticker", "Sector", "Industry",
                      *[(F.col(f"`{c}`") * 0.9).alias(c) for c in schemas.FUNDAMENTAL_NUMERIC])
    gone = (read_table(spark, sf, "part").select(F.concat(F.lit("P"), B.symbol("p_size")).alias("Ticker")).distinct())
    return schemas.conform(old.unionByName(gone, allowMissingColumns=True), schemas.FUNDAMENTALS_SCHEMA)


@register("q_backfill", sql=f"""
WITH {_AGG},
good AS (SELECT * FROM fund WHERE NOT neg),
gone AS (SELECT DISTINCT 'P' || translate(CAST(p_size AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS "Ticker" FROM part),
stored AS (SELECT "Ticker" FROM good UNION ALL SELECT "Ticker" FROM gone),
bf AS (SELECT "Ticker", "Sector", "Profit Margin", "Revenue (ttm)", 'fresh' AS origin FROM good
       UNION ALL
       SELECT "Ticker", NULL, NULL, NULL, 'stored' FROM gone WHERE "Ticker" NOT IN (SELECT "Ticker" FROM good))
SELECT "Ticker", "Sector", round("Profit Margin", 6) AS "Profit Margin", round("Revenue (ttm)", 6) AS "Revenue (ttm)", origin
FROM bf""")
def q_backfill(spark, sf):
    """J7 + U2 + U4 + W9 + P11 + T5: refreshed rows win, stored rows of keys
    not refreshed are kept, sorted by ticker."""
    from riskfold.session import cut_lineage
    good, _ = FU.split_failures(FU.assemble(FU.wide_records(provider_records(spark, sf))))
    good = cut_lineage(good)       # one row per ticker; feeds both sides below
    stored = stored_fundamentals(spark, sf, good)
    m = FU.backfill(good.withColumn("origin", F.lit("fresh")), stored.withColumn("origin", F.lit("stored")))
    m = m.orderBy("Ticker")
    return m.select("Ticker", "Sector", F.round(F.col("`Profit Margin`"), 6).alias("Profit Margin"),
                    F.round(F.col("`Revenue (ttm)`"), 6).alias("Revenue (ttm)"), "origin")


# Snapshot field -> report column of the live snapshot.
SNAPSHOT_FIELDS = {"Ticker": "symbol", "Company": "longName", "Sector": "sector", "Market Cap": "marketCap",
                   "Diluted EPS (ttm)": "trailingEps", "Profit Margin": "profitMargins"}


@register("q_field_map", sql="""
SELECT CAST(json_extract_string(props, '$.k') AS VARCHAR) AS "Ticker",
       event_type AS "Company", CAST(NULL AS VARCHAR) AS "Sector", CAST(value AS VARCHAR) AS "Market Cap",
       CAST(user_id AS VARCHAR) AS "Diluted EPS (ttm)", CAST(NULL AS VARCHAR) AS "Profit Margin"
FROM events""")
def q_field_map(spark, sf):
    """P13 + P14: rename-map projection of snapshot records; nested values
    (the JSON object in 'sector', the list in 'profitMargins') become null."""
    e = read_table(spark, sf, "events")
    snap = e.select(F.get_json_object("props", "$.k").alias("symbol"), F.col("event_type").alias("longName"),
                    F.col("props").alias("sector"), F.col("value").cast("string").alias("marketCap"),
                    F.col("user_id").cast("string").alias("trailingEps"),
                    F.concat(F.lit("["), F.col("value").cast("string"), F.lit("]")).alias("profitMargins"))
    out = FU.field_map(snap, SNAPSHOT_FIELDS)
    return out.select(*[F.col(f"`{c}`") for c in SNAPSHOT_FIELDS])


def constituents(spark, sf):
    """Index-constituent JSON lists, one per region, written from suppliers
    (symbols in supplier-key order, some lower case with dots)."""
    s = read_table(spark, sf, "supplier")
    n = read_table(spark, sf, "nation")
    j = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
    sym = F.when(F.col("s_suppkey") % 2 == 0, F.lower(F.concat(B.symbol("s_suppkey"), F.lit(".b")))).otherwise(
        B.symbol("s_suppkey"))
    return j.groupBy("n_regionkey", (F.col("s_suppkey") / 500).cast("long").alias("blk")).agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", sym.alias("symbol")))),
                              lambda x: F.struct(x["symbol"].alias("symbol")))).alias("body"))


@register("q_index_tickers", sql="""
WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0
                  THEN upper(lower(translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') || '.b'))
                  ELSE translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') END AS t FROM supplier)
SELECT DISTINCT replace(trim(t), '.', '-') AS ticker FROM s""")
def q_index_tickers(spark, sf):
    """S16 + S17 + F3 + A19: distinct normalised symbols of the landed
    index-constituent lists."""
    t = FU.tickers_from_index(constituents(spark, sf))
    return t.select("ticker").distinct()


@register("q_refresh_pipeline", sql=f"""
WITH {_AGG}
SELECT "Ticker", "Sector", round("Revenue (ttm)", 6) AS "Revenue (ttm)", 'current' AS part FROM fund WHERE NOT neg
UNION ALL SELECT translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS t, 'stored', round(s_acctbal, 6), 'current' FROM supplier
WHERE translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') NOT IN (SELECT "Ticker" FROM fund WHERE NOT neg)
UNION ALL SELECT "Ticker", NULL, NULL, 'failures' FROM fund WHERE neg""")
def q_refresh_pipeline(spark, sf):
    """R13 (S3 S4 S17 P11 U4 K1 K8 K9 K10): ticker list from CSV -> assemble
    -> conform -> back-fill with the stored CSV of an earlier run (lower-case
    keys; the rows of tickers that fail now stay) -> new version of the table
    -> dead letters; returns the written tables."""
    import os
    import uuid
    from riskfold.session import checkpoint_dir
    from riskfold.sources import files
    root = os.path.join(checkpoint_dir(spark), "tables", f"fund-{uuid.uuid4().hex[:12]}")
    recs = provider_records(spark, sf)
    files.write_csv(recs.select(F.col("ticker").alias("Ticker")).distinct(), f"{root}/tickers")
    tickers = files.tickers_from_csv(spark, f"{root}/tickers")
    wide = FU.wide_records(recs.join(tickers.select("ticker"), "ticker", "left_semi"))
    good, bad = FU.split_failures(FU.assemble(wide))
    earlier = read_table(spark, sf, "supplier").select(F.lower(B.symbol("s_suppkey")).alias("Ticker"), F.lit("stored").alias("Sector"),
                                                       F.col("s_acctbal").alias("Revenue (ttm)"))
    files.write_csv(schemas.conform(earlier, schemas.FUNDAMENTALS_SCHEMA), f"{root}/fundamentals.csv")
    stored = files.load_fundamentals(spark, f"{root}/fundamentals.csv")
    merged = FU.backfill(good, schemas.conform(stored, schemas.FUNDAMENTALS_SCHEMA))
    cur = files.snapshot_then_overwrite(merged, f"{root}/fundamentals").read("current")
    files.write_csv(bad, f"{root}/failures")
    fails = files.read_csv(spark, f"{root}/failures", schemas.T.StructType(
        [schemas.T.StructField("Ticker", schemas.S), schemas.T.StructField("_error", schemas.S)]))
    return (cur.select("Ticker", "Sector", F.round(F.col("`Revenue (ttm)`"), 6).alias("Revenue (ttm)"),
                       F.lit("current").alias("part"))
            .unionByName(fails.select("Ticker", F.lit(None).cast("string").alias("Sector"),
                                      F.lit(None).cast("double").alias("Revenue (ttm)"), F.lit("failures").alias("part"))))
