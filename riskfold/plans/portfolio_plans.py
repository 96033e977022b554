"""Portfolio and risk-score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfold.functions.numbers import round_money
from riskfold.operators import market, portfolio, risk, search
from riskfold.plans import bindings as B
from riskfold.plans import sql_fragments as S
from riskfold.plans.catalog import register
from riskfold.session import cut_lineage
from riskfold.sources.tables import read_table


def weights_of(spark, sf, price_table=None):
    priced = portfolio.attach_prices(B.positions(spark, sf), B.latest_prices(spark, sf, price_table))
    return portfolio.weights(priced)


def weights_and_universe(spark, sf, min_obs: int = B.MIN_OBS):
    """Both derive from one written price table."""
    pt = B.price_table(spark, sf)
    return weights_of(spark, sf, pt), B.universe(spark, sf, pt, min_obs)


_SCORE_CTES = f"""
WITH {S.UNIVERSE}, {S.WEIGHTS},
j AS (SELECT w.portfolio_id, w.ticker, w.weight, u.sector, u.sigma, u.mdd, u.beta,
             u.ticker IS NOT NULL AS m
      FROM w LEFT JOIN universe u USING (ticker)),
sec AS (SELECT portfolio_id, coalesce(sector, 'Unknown') AS sector, sum(weight) AS sw,
               sum(CASE WHEN m THEN weight END) AS mw,
               sum(CASE WHEN m THEN weight * sigma END) AS ws,
               sum(CASE WHEN m THEN weight * mdd END) AS wm,
               sum(CASE WHEN m THEN weight * beta END) AS wb,
               count(CASE WHEN m THEN 1 END) AS nm
        FROM j GROUP BY 1, 2),
a AS (SELECT portfolio_id, sum(nm) AS nm, sum(mw) AS mw, sum(sw * sw) AS hhi,
             sum(ws) / sum(mw) AS sigma_p, sum(wm) / sum(mw) AS mdd_p, sum(wb) / sum(mw) AS beta_p
      FROM sec GROUP BY 1),
q AS (SELECT quantile_cont(sigma, [0.25, 0.5, 0.75]) AS qs,
             quantile_cont(abs(mdd), [0.25, 0.5, 0.75]) AS qm,
             quantile_cont(beta, [0.25, 0.5, 0.75]) AS qb
      FROM universe WHERE sigma IS NOT NULL AND mdd IS NOT NULL AND beta IS NOT NULL),
z AS (SELECT a.*,
        CASE WHEN (SELECT qs[3] - qs[1] FROM q) = 0 THEN 0 ELSE
          greatest(-3, least(3, (sigma_p - (SELECT qs[2] FROM q)) / (SELECT qs[3] - qs[1] FROM q))) END AS zs,
        CASE WHEN (SELECT qm[3] - qm[1] FROM q) = 0 THEN 0 ELSE
          greatest(-3, least(3, (abs(mdd_p) - (SELECT qm[2] FROM q)) / (SELECT qm[3] - qm[1] FROM q))) END AS zm,
        CASE WHEN (SELECT qb[3] - qb[1] FROM q) = 0 THEN 0 ELSE
          greatest(-3, least(3, (beta_p - (SELECT qb[2] FROM q)) / (SELECT qb[3] - qb[1] FROM q))) END AS zb
      FROM a),
s AS (SELECT z.*, 0.35 * zs - 0.25 * zm + 0.20 * zb + 0.10 * 0.0 AS score FROM z)"""


@register("q_srisk_v1", sql=_SCORE_CTES + """
SELECT portfolio_id,
       CASE WHEN nm > 0 THEN round(score, 4) + 0.0 END AS srisk,
       CASE WHEN nm > 0 THEN CASE WHEN score < 0.33 THEN 'SAFE' WHEN score < 0.66 THEN 'NEUTRAL'
                                  ELSE 'AGGRESSIVE' END END AS category,
       CASE WHEN nm > 0 THEN round(sigma_p, 4) + 0.0 END AS sigma_p,
       CASE WHEN nm > 0 THEN round(mdd_p, 4) + 0.0 END AS mdd_p,
       CASE WHEN nm > 0 THEN round(beta_p, 4) + 0.0 END AS beta_p,
       CASE WHEN nm > 0 THEN round(hhi, 4) + 0.0 END AS hhi,
       CASE WHEN nm = 0 THEN 'no ticker of the portfolio is in the universe' END AS error
FROM s""")
def q_srisk_v1(spark, sf):
    """Flagship: A1-A5, A14, A16, A17 over every portfolio."""
    return risk.score_portfolios(*weights_and_universe(spark, sf))


@register("q_weighted_risk", sql=_SCORE_CTES.replace(S.UNIVERSE, S.FULL_UNIVERSE) + """
SELECT portfolio_id, nm AS n_matched, round(mw, 6) AS matched_weight, round(sigma_p, 6) AS sigma_p,
       round(mdd_p, 6) AS mdd_p, round(beta_p, 6) AS beta_p
FROM a""")
def q_weighted_risk(spark, sf):
    """A1 + J3: weighted sigma / mdd / beta over matched tickers (some holdings
    have no complete history, hence no metrics)."""
    a = risk.portfolio_aggregates(*weights_and_universe(spark, sf, B.FULL_OBS))
    return a.select("portfolio_id", "n_matched", F.round("matched_weight", 6).alias("matched_weight"),
                    *[F.round(c, 6).alias(c) for c in ("sigma_p", "mdd_p", "beta_p")])


@register("q_sector_hhi", sql=f"""
WITH {S.UNIVERSE}, {S.WEIGHTS},
sec AS (SELECT w.portfolio_id, coalesce(u.sector, 'Unknown') AS sector, sum(w.weight) AS sw
        FROM w LEFT JOIN universe u USING (ticker) GROUP BY 1, 2)
SELECT portfolio_id, round(sum(sw * sw), 6) AS hhi, count(*) AS n_sectors,
       first(sector ORDER BY sw DESC, sector) AS top_sector
FROM sec GROUP BY 1""")
def q_sector_hhi(spark, sf):
    """A2 + A3 + N3: sector exposure, HHI and the heaviest sector."""
    exp = portfolio.sector_exposure(*weights_and_universe(spark, sf), digits=15)
    m = portfolio.sector_map_column(exp)
    top = F.array_sort(F.map_entries("sectors"),
                       lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1)
                       .when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    hhi = F.aggregate(F.map_values("sectors"), F.lit(0.0), lambda acc, x: acc + x * x)
    return m.select("portfolio_id", F.round(hhi, 6).alias("hhi"), F.size("sectors").cast("long").alias("n_sectors"),
                    top.getItem(0)["key"].alias("top_sector"))


@register("q_robust_z", sql=f"""
WITH {S.UNIVERSE},
q AS (SELECT quantile_cont(sigma, [0.25, 0.5, 0.75]) AS qs,
             quantile_cont(abs(mdd), [0.25, 0.5, 0.75]) AS qm,
             quantile_cont(beta, [0.25, 0.5, 0.75]) AS qb FROM universe)
SELECT ticker,
  round(CASE WHEN qs[3] = qs[1] THEN 0 ELSE greatest(-3, least(3, (sigma - qs[2]) / (qs[3] - qs[1]))) END, 6) AS z_sigma,
  round(CASE WHEN qm[3] = qm[1] THEN 0 ELSE greatest(-3, least(3, (abs(mdd) - qm[2]) / (qm[3] - qm[1]))) END, 6) AS z_mdd,
  round(CASE WHEN qb[3] = qb[1] THEN 0 ELSE greatest(-3, least(3, (beta - qb[2]) / (qb[3] - qb[1]))) END, 6) AS z_beta,
  round(qs[1], 6) AS sigma_q1, round(qs[2], 6) AS sigma_med, round(qs[3], 6) AS sigma_q3
FROM universe, q""")
def q_robust_z(spark, sf):
    """A4 + A5: exact quartiles of the universe and each security's robust z."""
    u = B.universe(spark, sf)
    q = risk.universe_quartiles(u)
    return u.select("ticker",
                    F.round(risk.robust_z(F.col("sigma"), q.getField("sigma")), 6).alias("z_sigma"),
                    F.round(risk.robust_z(F.abs(F.col("mdd")), q.getField("mdd")), 6).alias("z_mdd"),
                    F.round(risk.robust_z(F.col("beta"), q.getField("beta")), 6).alias("z_beta"),
                    F.round(q.getField("sigma").getItem(0), 6).alias("sigma_q1"),
                    F.round(q.getField("sigma").getItem(1), 6).alias("sigma_med"),
                    F.round(q.getField("sigma").getItem(2), 6).alias("sigma_q3"))


@register("q_srisk_v2", sql=f"""
WITH {S.UNIVERSE}, {S.WEIGHTS},
pc AS (SELECT portfolio_id, CAST(ticker AS VARCHAR) AS ticker, market_value FROM pv
       UNION ALL SELECT c_custkey, 'CASH', CAST(c_acctbal AS DOUBLE) FROM customer WHERE c_acctbal > 0),
wc AS (SELECT portfolio_id, ticker, market_value / sum(market_value) OVER (PARTITION BY portfolio_id) AS weight FROM pc),
pf AS (SELECT wc.portfolio_id, wc.ticker, wc.weight, u.sector, u.sigma, u.mdd, u.beta
       FROM wc JOIN universe u ON CAST(u.ticker AS VARCHAR) = wc.ticker
       UNION ALL
       SELECT portfolio_id, ticker, weight, 'Cash', 0.0, 0.0, 0.0 FROM wc WHERE ticker = 'CASH'),
sec AS (SELECT portfolio_id, sector, sum(weight) AS sw, sum(weight * sigma) AS ws, sum(weight * mdd) AS wm,
               sum(weight * beta) AS wb, sum(CASE WHEN ticker = 'CASH' THEN weight ELSE 0.0 END) AS cw
        FROM pf GROUP BY 1, 2),
a AS (SELECT portfolio_id, sum(sw * sw) AS hhi, sum(cw) AS cash_p, sum(ws) / sum(sw) AS sigma_p,
             abs(sum(wm) / sum(sw)) AS mdd_p, sum(wb) / sum(sw) AS beta_p FROM sec GROUP BY 1),
st AS (SELECT avg(sigma) ms, stddev_samp(sigma) ss, avg(abs(mdd)) mm, stddev_samp(abs(mdd)) sm,
              avg(beta) mb, stddev_samp(beta) sb, count(*) AS n FROM universe),
sh AS (SELECT avg(s2) AS m, stddev_samp(s2) AS s
       FROM (SELECT pow(count(*) / (SELECT n FROM st), 2) AS s2 FROM universe GROUP BY sector)),
z AS (SELECT a.*,
        0.30 * CASE WHEN coalesce(ss, 0) > 0 THEN (sigma_p - ms) / ss ELSE 0 END
      + 0.25 * CASE WHEN coalesce(sm, 0) > 0 THEN (mdd_p - mm) / sm ELSE 0 END
      + 0.20 * CASE WHEN coalesce(sb, 0) > 0 THEN (beta_p - mb) / sb ELSE 0 END
      + 0.15 * CASE WHEN coalesce(sh.s, 0) > 0 THEN (hhi - sh.m) / sh.s ELSE 0 END
      - 0.05 * cash_p AS score
      FROM a, st, sh)
SELECT portfolio_id, round(score, 4) + 0.0 AS srisk,
       CASE WHEN score < 0.33 THEN 'SAFE' WHEN score < 0.66 THEN 'NEUTRAL' ELSE 'AGGRESSIVE' END AS category,
       round(sigma_p, 4) + 0.0 AS sigma_p, round(mdd_p, 4) + 0.0 AS mdd_p, round(beta_p, 4) + 0.0 AS beta_p,
       round(hhi, 4) + 0.0 AS hhi, round(cash_p, 4) + 0.0 AS cash_p
FROM z""")
def q_srisk_v2(spark, sf):
    """Score variant 2 over every portfolio, cash included."""
    pt = B.price_table(spark, sf)
    held = B.positions(spark, sf).withColumn("ticker", F.col("ticker").cast("string"))
    quotes = B.latest_prices(spark, sf, pt).select(F.col("ticker").cast("string").alias("ticker"), "price")
    priced = portfolio.attach_prices(held, quotes).select("portfolio_id", "ticker", "quantity", "price").unionByName(
        B.cash_positions(spark, sf).withColumn("price", F.lit(1.0)))
    u = B.universe(spark, sf, pt).withColumn("ticker", F.col("ticker").cast("string"))
    return risk.score_portfolios_v2(portfolio.weights(priced), u)


@register("q_weights", sql=f"""
WITH {S.PRICES}, {S.WEIGHTS}
SELECT portfolio_id, ticker, quantity, round(price, 4) AS price,
       CAST(round(CAST(market_value AS DECIMAL(38, 6)), 2) AS DOUBLE) AS market_value,
       round(weight, 4) AS weight,
       row_number() OVER (PARTITION BY portfolio_id ORDER BY weight DESC, ticker) AS rank,
       CAST(round(CAST(total_value AS DECIMAL(38, 6)), 2) AS DOUBLE) AS total_value
FROM w""")
def q_weights(spark, sf):
    """M6 + W6 + A13 + T3 + P25: market value, weight and allocation order."""
    w = weights_of(spark, sf)
    a = portfolio.allocation(w)
    tot = w.select("portfolio_id", "ticker", round_money("total_value", 2).alias("total_value"))
    return a.join(tot, ["portfolio_id", "ticker"]).withColumn("rank", F.col("rank").cast("long"))


@register("q_pie_cumsum", sql=f"""
WITH {S.PRICES}, {S.WEIGHTS},
r AS (SELECT portfolio_id, ticker, weight,
             sum(weight) OVER (PARTITION BY portfolio_id ORDER BY weight DESC, ticker
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e,
             row_number() OVER (PARTITION BY portfolio_id ORDER BY weight DESC, ticker) AS k
      FROM w)
SELECT portfolio_id, ticker, round(weight, 6) AS weight, round(e - weight, 6) AS slice_start,
       round(e, 6) AS slice_end, CAST((k - 1) % 8 AS INTEGER) AS color_slot
FROM r""")
def q_pie_cumsum(spark, sf):
    """Cumulative pie slices and colour slots."""
    return portfolio.pie_slices(weights_of(spark, sf))


@register("q_latest_price", sql=f"""
WITH {S.PRICES}, {S.POSITIONS}, {S.LATEST}
SELECT p.portfolio_id, p.ticker, round(lp.price, 4) AS price, strftime(lp.price_ts, '%Y-%m-%d') AS price_ts,
       lp.price IS NOT NULL AND lp.price > 0 AS price_ok
FROM pos p LEFT JOIN lp USING (ticker)""")
def q_latest_price(spark, sf):
    """W10 + E3 + P21: latest price of each held security, flagged."""
    lp = B.latest_prices(spark, sf)
    j = portfolio.attach_prices(B.positions(spark, sf), lp).join(lp.select("ticker", "price_ts"), "ticker", "left")
    return j.select("portfolio_id", "ticker", F.round("price", 4).alias("price"),
                    F.date_format("price_ts", "yyyy-MM-dd").alias("price_ts"), "price_ok")


@register("q_demo_prices", sql=f"""
WITH {S.FULL_UNIVERSE}, {S.POSITIONS}, {S.LATEST},
j AS (SELECT p.portfolio_id, p.ticker, CASE WHEN u.ticker IS NOT NULL THEN lp.price END AS live, s.s_acctbal AS demo
      FROM pos p LEFT JOIN universe u ON u.ticker = p.ticker LEFT JOIN lp ON lp.ticker = p.ticker LEFT JOIN supplier s ON s.s_suppkey = p.ticker)
SELECT portfolio_id, ticker, round(CASE WHEN live > 0 THEN live ELSE demo END, 4) AS price, coalesce(live > 0, false) = false AND demo IS NOT NULL AS used_demo,
       coalesce(CASE WHEN live > 0 THEN live ELSE demo END > 0, false) AS price_ok
FROM j""")
def q_demo_prices(spark, sf):
    """E3 + P21: live prices of the securities with a complete history; the others
    fall back to a demo price (the supplier's balance, not positive for some:
    those positions are flagged)."""
    table = B.price_table(spark, sf)
    live = B.latest_prices(spark, sf, table).join(B.universe(spark, sf, table, min_obs=B.FULL_OBS).select("ticker"), "ticker", "left_semi")
    demo = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ticker"), F.col("s_acctbal").cast("double").alias("price"))
    j = portfolio.attach_prices(B.positions(spark, sf), live, demo)
    return j.select("portfolio_id", "ticker", F.round("price", 4).alias("price"), "used_demo", "price_ok")


@register("q_symbol_sectors", sql=f"""
WITH {S.POSITIONS},
held AS (SELECT DISTINCT {S.SYMBOL.format('ticker')} || CASE WHEN ticker % 3 = 0 THEN '.b' ELSE '' END AS symbol, ticker FROM pos)
SELECT symbol, CASE WHEN s.s_acctbal >= 0 THEN n.n_name ELSE 'Unknown' END AS sector
FROM held LEFT JOIN supplier s ON s.s_suppkey = held.ticker LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey""")
def q_symbol_sectors(spark, sf):
    """J14 + F3: sectors of the held symbols, spelled with '.' and in lower case
    here and with '-' in the map; suppliers in debt are not in the map."""
    held = B.positions(spark, sf).select("ticker").distinct()
    spelled = lambda mark: F.concat(B.symbol("ticker"), F.when(F.col("ticker") % 3 == 0, F.lit(mark)).otherwise(F.lit("")))
    mapped = (B.sectors(spark, sf).join(read_table(spark, sf, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("ticker")), "ticker")
              .select(spelled("-B").alias("ticker"), "sector"))
    out = market.attach_sectors(held.select(spelled(".b").alias("symbol")), mapped, "symbol")
    return out.select("symbol", "sector")


@register("q_missing_tickers", sql=f"""
WITH {S.FULL_UNIVERSE}, {S.POSITIONS}
SELECT portfolio_id, ticker FROM pos WHERE ticker NOT IN (SELECT ticker FROM universe)""")
def q_missing_tickers(spark, sf):
    """J5 + U3 + E1: held securities missing from the universe of complete
    histories."""
    return portfolio.missing_tickers(B.positions(spark, sf), B.universe(spark, sf, min_obs=B.FULL_OBS))


@register("q_holdings", sql=f"""
WITH {S.UNIVERSE}, {S.WEIGHTS}
SELECT w.portfolio_id, w.ticker, round(w.weight, 4) AS weight, u.sector,
       round(coalesce(u.sigma, 0), 4) AS sigma, round(coalesce(u.mdd, 0), 4) AS mdd,
       round(coalesce(u.beta, 0), 4) AS beta,
       row_number() OVER (PARTITION BY w.portfolio_id ORDER BY w.weight DESC, w.ticker) AS rank
FROM w JOIN universe u USING (ticker)""")
def q_holdings(spark, sf):
    """J4 + J15 + P25 + T4: holdings table per portfolio."""
    h = portfolio.holdings(*weights_and_universe(spark, sf))
    return h.withColumn("rank", F.col("rank").cast("long"))


@register("q_top_sigma", sql=f"""
WITH {S.UNIVERSE}
SELECT ticker, sector, round(sigma, 4) AS sigma, round(mdd, 4) AS mdd, round(beta, 4) AS beta
FROM universe ORDER BY universe.sigma DESC, ticker LIMIT 12""")
def q_top_sigma(spark, sf):
    """The 12 most volatile securities."""
    return risk.top_by(B.universe(spark, sf), "sigma", 12)


@register("q_ticker_options", sql=f"""
WITH {S.FULL_UNIVERSE}
SELECT {S.SYMBOL.format('ticker')} AS symbol, sector FROM universe
UNION SELECT {S.SYMBOL.format('s_suppkey')}, coalesce(n_name, 'Unknown') FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""")
def q_ticker_options(spark, sf):
    """T5 + A19 + U1: options of two universes (securities with a complete
    price history, securities with fundamentals), distinct, sorted."""
    u = B.universe(spark, sf, min_obs=B.FULL_OBS)
    other = B.sectors(spark, sf).select("ticker", F.coalesce("sector", F.lit("Unknown")).alias("sector"))
    both = u.select("ticker", "sector").unionByName(other).select(B.symbol("ticker").alias("symbol"), "sector")
    return both.distinct().orderBy("symbol")


_SEARCH_LOG = f"""
qs AS (SELECT event_id AS query_id,
              lower({S.SYMBOL.format("CAST(json_extract_string(props, '$.k') AS BIGINT)")}) AS query
       FROM events)"""


def search_log(spark, sf):
    """Search log binding: every event searched the symbol of its k."""
    e = read_table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(F.col("event_id").alias("query_id"), F.lower(B.symbol(k)).alias("query"))


@register("q_ticker_search", sql=f"""
WITH {S.UNIVERSE}, {_SEARCH_LOG},
opt AS (SELECT DISTINCT {S.SYMBOL.format('ticker')} AS ticker, sector FROM universe),
sc AS (SELECT qs.query_id, qs.query, opt.ticker, opt.sector,
              CASE WHEN lower(opt.ticker) = lower(trim(qs.query)) THEN 0
                   WHEN starts_with(lower(opt.ticker), lower(trim(qs.query))) THEN 1
                   WHEN contains(lower(opt.ticker), lower(trim(qs.query))) THEN 2
                   WHEN contains(lower(coalesce(opt.sector, '')), lower(trim(qs.query))) THEN 3
                   ELSE 99 END AS score
       FROM qs, opt),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, ticker) AS rank
      FROM sc WHERE score < 99)
SELECT query_id, query, ticker, sector, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""")
def q_ticker_search(spark, sf):
    """T8 + T10: ranked symbol search for every query of the search log."""
    u = B.universe(spark, sf)
    opts = u.select(B.symbol("ticker").alias("ticker"), "sector").distinct()
    return search.rank_matches(search_log(spark, sf), opts).withColumn("rank", F.col("rank").cast("int"))


@register("q_resolve_symbol", sql=f"""
WITH {S.UNIVERSE}, {_SEARCH_LOG},
opt AS (SELECT DISTINCT {S.SYMBOL.format('ticker')} AS ticker, sector FROM universe),
t AS (SELECT DISTINCT query FROM qs),
sc AS (SELECT t.query, opt.ticker, CASE WHEN lower(opt.ticker) = t.query THEN 0 WHEN starts_with(lower(opt.ticker), t.query) THEN 1
              WHEN contains(lower(opt.ticker), t.query) THEN 2 WHEN contains(lower(opt.sector), t.query) THEN 3 ELSE 99 END AS score FROM t, opt),
r AS (SELECT query, arg_min(ticker, printf('%02d', score) || ticker) AS resolved, min(score) = 0 AS exact FROM sc WHERE score < 99 GROUP BY 1)
SELECT qs.query_id, qs.query, r.resolved, coalesce(r.exact, false) AS exact FROM qs LEFT JOIN r USING (query)""")
def q_resolve_symbol(spark, sf):
    """What every typed text of the search log stands for."""
    opts = B.universe(spark, sf).select(B.symbol("ticker").alias("ticker"), "sector").distinct()
    return search.resolve(search_log(spark, sf), opts)


_TEXT_FIXTURE = f"""
tx AS (SELECT portfolio_id,
              string_agg(printf('%s %.2f', {S.SYMBOL.format('ticker')}, quantity), ', '
                         ORDER BY {S.SYMBOL.format('ticker')}) AS raw
       FROM pos GROUP BY portfolio_id)"""


def positions_text(spark, sf):
    """Portfolio texts written from the positions."""
    pos = B.positions(spark, sf).withColumn("ticker", B.symbol("ticker"))
    return portfolio.portfolio_text(pos)


@register("q_parse_portfolio", sql=f"""
WITH {S.POSITIONS}, {_TEXT_FIXTURE}
SELECT portfolio_id, upper(replace(regexp_extract(trim(item), '^([A-Za-z.\\-]+)\\s+([0-9]*\\.?[0-9]+)$', 1), '.', '-')) AS ticker,
       CAST(regexp_extract(trim(item), '^([A-Za-z.\\-]+)\\s+([0-9]*\\.?[0-9]+)$', 2) AS DOUBLE) AS quantity,
       CAST(pos AS INTEGER) AS pos
FROM (SELECT portfolio_id, unnest(string_split(raw, ',')) AS item,
             generate_subscripts(string_split(raw, ','), 1) - 1 AS pos FROM tx)
WHERE trim(item) <> ''""")
def q_parse_portfolio(spark, sf):
    """S14 + P24 + F5 + F17: write every portfolio as text and parse it back."""
    parsed = portfolio.parse_portfolio_text(positions_text(spark, sf))
    return parsed.where("keep").select("portfolio_id", "ticker", "quantity", F.col("pos").cast("int").alias("pos"))


@register("q_position_upsert", sql=f"""
WITH {S.POSITIONS},
ch AS (SELECT portfolio_id, ticker, quantity * 2 AS quantity FROM pos
       WHERE ticker = (SELECT max(ticker) FROM pos p2 WHERE p2.portfolio_id = pos.portfolio_id)),
rm AS (SELECT portfolio_id, ticker FROM pos
       WHERE ticker = (SELECT min(ticker) FROM pos p2 WHERE p2.portfolio_id = pos.portfolio_id)),
up AS (SELECT * FROM pos WHERE (portfolio_id, ticker) NOT IN (SELECT (portfolio_id, ticker) FROM ch)
       UNION ALL SELECT * FROM ch)
SELECT portfolio_id, ticker, quantity FROM up
WHERE (portfolio_id, ticker) NOT IN (SELECT (portfolio_id, ticker) FROM rm)""")
def q_position_upsert(spark, sf):
    """N4 + N5: double each portfolio's highest-key position (upsert) and
    remove its lowest-key one."""
    pos = cut_lineage(B.positions(spark, sf))   # one row per (portfolio, security), read twice
    ends = pos.groupBy("portfolio_id").agg(F.max("ticker").alias("hi"), F.max_by("quantity", "ticker").alias("q"),
                                           F.min("ticker").alias("lo"))
    ch = ends.select("portfolio_id", F.col("hi").alias("ticker"), (F.col("q") * 2).alias("quantity"))
    rm = ends.select("portfolio_id", F.col("lo").alias("ticker"))
    return portfolio.edit_positions(pos, ch, rm)


@register("q_named_portfolios", sql=_SCORE_CTES + """
SELECT c.c_name AS investor, round(score, 4) + 0.0 AS srisk,
       CASE WHEN score < 0.33 THEN 'SAFE' WHEN score < 0.66 THEN 'NEUTRAL' ELSE 'AGGRESSIVE' END AS category,
       round(sigma_p, 4) + 0.0 AS sigma_p, round(mdd_p, 4) + 0.0 AS mdd_p, round(beta_p, 4) + 0.0 AS beta_p,
       round(hhi, 4) + 0.0 AS hhi
FROM s JOIN customer c ON c.c_custkey = s.portfolio_id""")
def q_named_portfolios(spark, sf):
    """S15 + A17 + T9: named portfolios landed as one JSON map document per
    investor ({name: {ticker: weight}}), exploded to long rows, scored and
    listed by score descending with nulls last."""
    w, u = weights_and_universe(spark, sf)
    w = w.select("portfolio_id", "ticker", "weight")
    cust = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("portfolio_id"), "c_name")
    maps = w.groupBy("portfolio_id").agg(   # one entry per held security (bounded by the universe)
        F.map_from_entries(F.collect_list(F.struct(F.col("ticker").cast("string"), "weight"))).alias("m"))
    docs = maps.join(cust, "portfolio_id").select(F.to_json(F.create_map("c_name", "m")).alias("doc"))
    long = portfolio.named_portfolios(docs).withColumn("ticker", F.col("ticker").cast("bigint"))
    sc = risk.score_portfolios(long, u, pid="investor")
    return (sc.select("investor", "srisk", "category", "sigma_p", "mdd_p", "beta_p", "hhi")
            .orderBy(F.desc_nulls_last("srisk"), "investor"))
