"""DuckDB CTE fragments shared by the oracles (the binding of §bindings in SQL)."""

PRICES = """
prices AS (
  SELECT l_suppkey AS ticker, date_trunc('month', l_shipdate) AS ts,
         avg(l_extendedprice) AS price
  FROM lineitem GROUP BY 1, 2)"""

UNIVERSE = PRICES + """,
rets AS (
  SELECT ticker, ts, price,
         ln(price / lag(price) OVER (PARTITION BY ticker ORDER BY ts)) AS ret
  FROM prices),
bench AS (SELECT ts, avg(price) AS price FROM prices GROUP BY ts),
bench_ret AS (
  SELECT ts, ln(price / lag(price) OVER (ORDER BY ts)) AS bench_ret FROM bench),
dd AS (
  SELECT ticker, ts, ret,
         product(1 + ret) OVER (PARTITION BY ticker ORDER BY ts
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM rets WHERE ret IS NOT NULL),
dd2 AS (
  SELECT *, cum / max(cum) OVER (PARTITION BY ticker ORDER BY ts
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS drawdown
  FROM dd),
um AS (
  SELECT d.ticker, count(*) + 1 AS n_obs, stddev_samp(d.ret) * sqrt(12) AS sigma,
         min(d.drawdown) AS mdd, regr_slope(d.ret, b.bench_ret) AS beta
  FROM dd2 d LEFT JOIN bench_ret b ON d.ts = b.ts
  GROUP BY d.ticker HAVING count(*) + 1 >= 60),
universe AS (
  SELECT um.ticker, coalesce(n.n_name, 'Unknown') AS sector,
         round(sigma, 6) AS sigma, round(mdd, 6) AS mdd, round(beta, 6) AS beta
  FROM um LEFT JOIN supplier s ON s.s_suppkey = um.ticker
          LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey)"""

# the same universe of securities with a complete history only
FULL_UNIVERSE = UNIVERSE.replace("count(*) + 1 >= 60", "count(*) + 1 >= 83")

POSITIONS = """
pos AS (
  SELECT o_custkey AS portfolio_id, l_suppkey AS ticker, sum(l_quantity) AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""

LATEST = """
lp AS (SELECT ticker, arg_max(price, ts) AS price, max(ts) AS price_ts FROM prices GROUP BY ticker)"""

WEIGHTS = POSITIONS + "," + LATEST + """,
pv AS (SELECT p.portfolio_id, p.ticker, p.quantity, lp.price, p.quantity * lp.price AS market_value
       FROM pos p LEFT JOIN lp USING (ticker)),
w AS (SELECT pv.*, t.total_value,
             CASE WHEN t.total_value > 0 THEN market_value / t.total_value END AS weight
      FROM pv JOIN (SELECT portfolio_id, sum(market_value) AS total_value FROM pv GROUP BY 1) t
      USING (portfolio_id))"""

# Letters spelled from the security key (0->A ... 9->J).
SYMBOL = "translate(CAST({} AS VARCHAR), '0123456789', 'ABCDEFGHIJ')"

ARTICLES = """
arts AS (
  SELECT CAST(doc_id AS VARCHAR) AS id,
         trim(regexp_extract(text, '^[^\\n.!?]*[.!?]?', 0)) AS headline,
         source AS ticker,
         CASE WHEN doc_id % 9 = 4 THEN NULL
              ELSE CAST(DATE '2024-03-01' - CAST(doc_id % 45 AS INTEGER) AS TIMESTAMP) END AS pubdate,
         text AS summary
  FROM documents)"""

RAW_NEWS = """
raw AS (
  SELECT doc_id AS doc_id, source AS ticker,
         trim(regexp_extract(text, '^[^\\n.!?]*[.!?]?', 0)) AS headline,
         CASE WHEN doc_id % 7 = 3 THEN '  ' ELSE 'https://news.example.com/' || source || '/' || CAST(doc_id AS VARCHAR) END AS link,
         CASE WHEN doc_id % 5 = 0 THEN 'https://m.example.com/a/' || CAST(doc_id AS VARCHAR) END AS final_url,
         CASE WHEN doc_id % 9 = 4 THEN NULL
              WHEN lang = 'en' THEN strftime(DATE '2024-03-01' - CAST(doc_id % 45 AS INTEGER), '%B %-d, %Y') || ' at 3:00 PM'
              WHEN lang = 'de' THEN strftime(DATE '2024-03-01' - CAST(doc_id % 45 AS INTEGER), '%-d-%b-%y')
              WHEN lang = 'fr' THEN strftime(DATE '2024-03-01' - CAST(doc_id % 45 AS INTEGER), '%Y-%m-%dT%H:%M:%S+00:00')
              ELSE 'date unknown' END AS pubdate,
         text AS summary, lang
  FROM documents)"""

# Free-form date normalisation in SQL (first 'Mon D, YYYY', else 'D-Mon-YY').
# month words are looked up by their first letters; every part is taken from
# the text separately and put together as year-month-day
_MONTH = "list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(substr({w}, 1, 3)))"
_MDY = r"(?i)\b([a-z]{{3,9}})\.? +([0-9]{{1,2}}), +([0-9]{{4}})"
_DMY = r"(?i)\b([0-9]{{1,2}})-([a-z]{{3}})-([0-9]{{2,4}})"


def _sql_part(pattern: str, k: int) -> str:
    return f"regexp_extract({{c}}, '{pattern}', {k})"


def _sql_day(year: str, month: str, day: str) -> str:
    return f"CAST(try_strptime({year} || '-' || {month} || '-' || {day}, '%Y-%m-%d') AS DATE)"


NORM_DATE = ("CASE WHEN " + _sql_part(_MDY, 0) + " <> '' THEN "
             + _sql_day(_sql_part(_MDY, 3), _MONTH.replace("{w}", _sql_part(_MDY, 1)), _sql_part(_MDY, 2))
             + " WHEN " + _sql_part(_DMY, 0) + " <> '' THEN "
             + _sql_day("CASE WHEN length(" + _sql_part(_DMY, 3) + ") = 2 THEN '20' ELSE '' END || " + _sql_part(_DMY, 3),
                        _MONTH.replace("{w}", _sql_part(_DMY, 2)), _sql_part(_DMY, 1))
             + " ELSE CAST(try_strptime(regexp_extract({c}, '^ *([0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}})', 1), '%Y-%m-%d') AS DATE) END")

PREP = RAW_NEWS + """,
rawn AS (SELECT raw.*, CAST(""" + NORM_DATE.format(c="raw.pubdate") + """ AS TIMESTAMP) AS nd FROM raw),
prep AS (
  SELECT sha1(coalesce(ticker, '') || '|' ||
              coalesce(NULLIF(coalesce(NULLIF(trim(final_url), ''), NULLIF(trim(link), '')), ''),
                       NULLIF(link, ''), NULLIF(headline, ''), '') || '|' ||
              coalesce(strftime(nd, '%Y-%m-%d %H:%M:%S+00:00'), 'NaT')) AS id,
         headline, ticker, nd AS pubdate, summary, doc_id AS src_order, lang
  FROM rawn WHERE ticker IS NOT NULL AND headline IS NOT NULL)"""
