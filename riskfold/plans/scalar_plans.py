"""Scalar / projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfold import schemas
from riskfold.functions import dates as D
from riskfold.functions import numbers as N
from riskfold.functions import text as X
from riskfold.plans import bindings as B
from riskfold.plans import sql_fragments as S
from riskfold.plans.catalog import register
from riskfold.sources.tables import read_table

_NUM = r"[-+]?\d*\.\d+|\d+"


@register("q_extract_number", sql=r"""
SELECT doc_id, TRY_CAST(NULLIF(regexp_extract(text, '[-+]?\d*\.\d+|\d+', 0), '') AS DOUBLE) AS first_number,
       TRY_CAST(NULLIF(regexp_extract(lang || ' ' || source, '[-+]?\d*\.\d+|\d+', 0), '') AS DOUBLE) AS source_number
FROM documents""")
def q_extract_number(spark, sf):
    """First number of every whole document text and of its source tag."""
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", N.extract_number("text").alias("first_number"),
                    N.extract_number(F.concat_ws(" ", "lang", "source")).alias("source_number"))


@register("q_symbol_norm", sql=r"""
SELECT p_partkey, replace(upper(trim(p_brand)), '.', '-') AS brand_symbol,
       NULLIF(upper(regexp_replace(p_name, '[^A-Za-z.]', '', 'g')), '') AS name_symbol,
       upper(trim(split_part(p_type, ' ', 1))) NOT IN ('SYMBOL', 'TICKER') AS not_header
FROM part""")
def q_symbol_norm(spark, sf):
    """F3 + F4 + P20: symbol normalisation and header-word filter flags."""
    p = read_table(spark, sf, "part")
    return p.select("p_partkey", X.symbol_norm("p_brand").alias("brand_symbol"),
                    X.symbol_clean("p_name").alias("name_symbol"),
                    X.not_header_word(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("not_header"))


@register("q_snake", sql=r"""
SELECT p_partkey,
  lower(regexp_replace(regexp_replace(regexp_replace(trim(p_type), '[\s\-]+', '_', 'g'), '[^0-9a-zA-Z_]', '', 'g'), '_+', '_', 'g')) AS type_snake,
  lower(regexp_replace(regexp_replace(regexp_replace(trim(p_brand || ' - ' || p_name), '[\s\-]+', '_', 'g'), '[^0-9a-zA-Z_]', '', 'g'), '_+', '_', 'g')) AS name_snake
FROM part""")
def q_snake(spark, sf):
    """F1 + P10: snake-case text."""
    p = read_table(spark, sf, "part")
    return p.select("p_partkey", X.snake("p_type").alias("type_snake"),
                    X.snake(F.concat_ws(" - ", "p_brand", "p_name")).alias("name_snake"))


@register("q_fmt_metric", sql=r"""
WITH tot AS (SELECT o_custkey, sum(o_totalprice) AS spend FROM orders GROUP BY 1)
SELECT c.c_custkey,
  printf('%.2f', round(CAST(c_acctbal AS DECIMAL(38, 6)), 2)) AS acctbal_txt,
  printf('%.1f%%', round(CAST(c_acctbal / 10000.0 * 100.0 AS DECIMAL(38, 6)), 1)) AS acctbal_pct,
  CASE WHEN spend IS NULL THEN 'N/A'
       WHEN abs(spend) >= 1e9 THEN printf('$%.1fB', round(CAST(spend / 1e9 AS DECIMAL(38, 6)), 1))
       WHEN abs(spend) >= 1e6 THEN printf('$%.1fM', round(CAST(spend / 1e6 AS DECIMAL(38, 6)), 1))
       ELSE printf('%.2f', round(CAST(spend AS DECIMAL(38, 6)), 2)) END AS spend_txt,
  format('{:,}', CAST(round(coalesce(spend, 0), 0) AS BIGINT)) AS spend_thousands
FROM customer c LEFT JOIN tot ON tot.o_custkey = c.c_custkey""")
def q_fmt_metric(spark, sf):
    """F9 + F10: human-readable numbers (N/A, percent, $B/$M, thousands)."""
    c = read_table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    tot = read_table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spend"))
    j = c.join(tot, c.c_custkey == tot.o_custkey, "left")
    return j.select("c_custkey",
                    N.fmt_fixed("c_acctbal", 2).alias("acctbal_txt"),
                    N.fmt_percent(F.col("c_acctbal") / 10000.0).alias("acctbal_pct"),
                    N.fmt_metric("spend").alias("spend_txt"),
                    N.fmt_thousands(F.coalesce("spend", F.lit(0.0))).alias("spend_thousands"))


_ENT = "replace(replace(replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')"


@register("q_clean_html", sql=r"""
SELECT page_id, c AS clean_text, length(c) AS clean_chars FROM (
  SELECT page_id, coalesce(trim(regexp_replace(regexp_replace(""" + _ENT.format(c="html") + r""", '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '') AS c
  FROM pages)""")
def q_clean_html(spark, sf):
    """whole pages to clean text (entities, tags, blanks)."""
    p = read_table(spark, sf, "pages")
    c = X.clean_html("html")
    return p.select("page_id", c.alias("clean_text"), F.length(c).cast("bigint").alias("clean_chars"))


# the named entities of the bundled pages besides the basic ones
_ENT_FULL = "replace(replace(" + _ENT + ", '&copy;', '©'), '&middot;', '·')"


@register("q_clean_html_full", sql=r"""
SELECT page_id, c AS clean_text, length(c) AS clean_chars FROM (
  SELECT page_id, coalesce(trim(regexp_replace(regexp_replace(""" + _ENT_FULL.format(c="html") + r""", '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '') AS c
  FROM pages)""")
def q_clean_html_full(spark, sf):
    """whole pages to clean text with the full entity table."""
    p = read_table(spark, sf, "pages")
    return p.select("page_id", X.clean_html("html", full_entities=True).alias("clean_text")).select(
        "page_id", "clean_text", F.length("clean_text").cast("bigint").alias("clean_chars"))


@register("q_url_host", sql=r"""
SELECT page_id, NULLIF(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '') AS host,
       replace(url_encode(regexp_extract(html, '<title>(.*?)</title>', 1)), '%20', '+') AS title_param
FROM pages""")
def q_url_host(spark, sf):
    """F6 + F16: URL host and the form-encoded page title."""
    p = read_table(spark, sf, "pages")
    return p.select("page_id", X.url_host("url").alias("host"),
                    X.quote_plus(F.regexp_extract("html", r"<title>(.*?)</title>", 1)).alias("title_param"))


@register("q_pubdate_norm", sql=f"""
WITH {S.RAW_NEWS}
SELECT doc_id, pubdate AS raw_pub_date,
       strftime({S.NORM_DATE.format(c='pubdate')}, '%Y-%m-%d') AS pubdate,
       coalesce(strftime(CAST({S.NORM_DATE.format(c='pubdate')} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S+00:00'), 'NaT') AS pubdate_text
FROM raw""")
def q_pubdate_norm(spark, sf):
    """X1 + X2 + X3: free-form publish dates -> UTC day."""
    r = schemas.snake_columns(B.raw_news(spark, sf))
    col = D.pick_pub_column(r)  # 'pubdate'
    ts = D.pubdate_timestamp(col)
    return r.select("doc_id", F.col(col).alias("raw_pub_date"),
                    F.date_format(ts, "yyyy-MM-dd").alias("pubdate"), D.pubdate_text(ts).alias("pubdate_text"))


@register("q_recency", sql=f"""
WITH {S.ARTICLES}
SELECT id, round(date_diff('second', pubdate, TIMESTAMP '{B.AS_OF}') / 86400.0, 6) AS age_days,
       round(CASE WHEN pubdate IS NULL THEN 0.5
                  ELSE exp(-0.25 * greatest(0.0, date_diff('second', pubdate, TIMESTAMP '{B.AS_OF}') / 86400.0)) END, 9) AS recency,
       pubdate IS NULL OR pubdate >= TIMESTAMP '{B.AS_OF}' - INTERVAL 14 DAYS AS keep_14d,
       pubdate IS NOT NULL AND TIMESTAMP '{B.AS_OF}' - pubdate < INTERVAL 900 SECONDS AS fresh_15m
FROM arts""")
def q_recency(spark, sf):
    """X4 + X5 + X6: age, recency score, retention cut-off, TTL freshness."""
    a = B.articles(spark, sf)
    return a.select("id", F.round(D.age_days("pubdate", B.AS_OF), 6).alias("age_days"),
                    F.round(D.recency_score("pubdate", B.AS_OF), 9).alias("recency"),
                    (F.col("pubdate").isNull() | (F.col("pubdate") >= D.cutoff(B.AS_OF, 14))).alias("keep_14d"),
                    F.coalesce(D.is_fresh("pubdate", B.AS_OF, 900), F.lit(False)).alias("fresh_15m"))


@register("q_primary_url", sql=f"""
WITH {S.RAW_NEWS}
SELECT doc_id, coalesce(NULLIF(trim(final_url), ''), NULLIF(trim(link), '')) AS primary_url,
       coalesce(NULLIF(trim(final_url), ''), NULLIF(trim(link), ''), NULLIF(trim(headline), ''), '') AS id_key
FROM raw""")
def q_primary_url(spark, sf):
    """F12 + F13: first non-blank URL column in priority order, then the
    id key fall-back chain (URL, headline, '')."""
    r = schemas.snake_columns(B.raw_news(spark, sf))
    url_cols = schemas.url_columns(r)
    prim = X.first_non_blank(*url_cols)
    return r.select("doc_id", prim.alias("primary_url"),
                    F.coalesce(prim, X.blank_to_null("title"), F.lit("")).alias("id_key"))


@register("q_json_props", sql="""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       coalesce(json_extract_string(props, '$.missing'), 'none') AS missing_default,
       CAST(json_extract_string(props, '$.k') AS BIGINT) * value AS k_value
FROM events""")
def q_json_props(spark, sf):
    """JSON field access with default."""
    e = read_table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select("event_id", k.alias("k"),
                    F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing_default"),
                    (k * F.col("value")).alias("k_value"))


@register("q_ratio_safe_div", sql="""
WITH agg AS (SELECT l_suppkey, sum(l_extendedprice) AS revenue,
                    sum(l_extendedprice * (1 - l_discount)) AS net, count(DISTINCT l_orderkey) AS orders
             FROM lineitem GROUP BY 1)
SELECT s.s_suppkey,
       round(CASE WHEN abs(s_acctbal / 100.0) > 3 THEN s_acctbal / 100.0 / 100.0 ELSE s_acctbal / 100.0 END, 9) AS margin,
       round(CASE WHEN agg.orders IS NULL OR agg.orders = 0 THEN NULL ELSE agg.revenue / agg.orders END, 6) AS revenue_per_order,
       round(coalesce(NULLIF(round(s_acctbal, 0), 0), agg.net / NULLIF(agg.orders, 0)), 6) AS picked_or_derived,
       round(sqrt(abs(s_acctbal)) + ln(1 + abs(s_acctbal)), 9) AS scalar_math
FROM supplier s LEFT JOIN agg ON agg.l_suppkey = s.s_suppkey""")
def q_ratio_safe_div(spark, sf):
    """M1 + M2 + M3 + M5 over supplier fundamentals."""
    s = read_table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    li = read_table(spark, sf, "lineitem")
    agg = li.groupBy("l_suppkey").agg(
        F.sum("l_extendedprice").alias("revenue"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        F.countDistinct("l_orderkey").alias("orders"))
    j = s.join(agg, s.s_suppkey == agg.l_suppkey, "left")
    return j.select("s_suppkey",
                    F.round(N.ratio_scale(F.col("s_acctbal") / 100.0), 9).alias("margin"),
                    F.round(N.safe_div("revenue", "orders"), 6).alias("revenue_per_order"),
                    F.round(N.pick_or_derive(F.round("s_acctbal", 0), N.safe_div("net", "orders")), 6)
                    .alias("picked_or_derived"),
                    F.round(F.sqrt(F.abs("s_acctbal")) + F.ln(1 + F.abs("s_acctbal")), 9).alias("scalar_math"))


@register("q_dropna_any_all", sql=f"""
WITH {S.ARTICLES},
x AS (SELECT id, pubdate, NULLIF(headline, '') AS headline FROM arts)
SELECT id, pubdate IS NOT NULL AND headline IS NOT NULL AS complete
FROM x WHERE NOT (pubdate IS NULL AND headline IS NULL)""")
def q_dropna_any_all(spark, sf):
    """P2 + P3: drop rows where *all* listed columns are null; flag rows
    that would survive the *any* rule."""
    a = B.articles(spark, sf).select("id", "pubdate", F.nullif("headline", F.lit("")).alias("headline"))
    kept = a.na.drop(how="all", subset=["pubdate", "headline"])
    complete = kept.na.drop(how="any", subset=["pubdate", "headline"]).select("id", F.lit(True).alias("_c"))
    return kept.join(complete, "id", "left").select("id", F.coalesce("_c", F.lit(False)).alias("complete"))


@register("q_conform", sql=f"""
WITH {S.RAW_NEWS}
SELECT CAST(NULL AS VARCHAR) AS id, headline, ticker,
       CAST({S.NORM_DATE.format(c='pubdate')} AS TIMESTAMP) AS pubdate, summary
FROM raw""")
def q_conform(spark, sf):
    """P9 + P10 + P11 + U5 + E4: snake names, aliases, conform to the
    article schema (missing columns null, fixed order)."""
    r = schemas.snake_columns(B.raw_news(spark, sf))
    r = schemas.apply_news_aliases(r)
    schemas.require_columns(r, ["ticker", "headline"])
    r = r.withColumn("pubdate", D.pubdate_timestamp("pubdate"))
    return schemas.conform(r, schemas.ARTICLE_SCHEMA)
