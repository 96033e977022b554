"""Binding of the bundled tables to the logical inputs of the engine.

* price history  : lineitem -> security = l_suppkey, period = month of
                   l_shipdate, close = avg(l_extendedprice)
* sector         : supplier -> nation name
* positions      : orders join lineitem -> portfolio = o_custkey,
                   ticker = l_suppkey, quantity = sum(l_quantity)
* latest price   : last monthly close of each security
* symbols        : letters spelled from the security key (0->A ... 9->J)
* articles       : documents -> id, ticker (= source), headline (first
                   sentence), pubdate (derived from doc_id), summary (= text)
* vector index   : embeddings -> id = vec_id, ticker = label

Each binding is a lazy DataFrame; the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.operators import market
from riskfold.session import cut_lineage
from riskfold.sources.tables import read_table

# Fixed parameters of the binding (monthly prices instead of daily ones).
MIN_OBS = 60
FULL_OBS = 83                  # months of a complete history; shorter ones leave the full universe
PERIODS_PER_YEAR = 12
NEWS_EPOCH = "2024-03-01"      # pubdate = epoch - (doc_id % 45) days
AS_OF = "2024-03-02 00:00:00"  # deterministic "now" for recency / retention


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice")
    return (li.groupBy(F.col("l_suppkey").alias("ticker"),
                       F.date_trunc("month", "l_shipdate").alias("ts"))
            .agg(F.avg("l_extendedprice").alias("close"))
            .withColumn("adj_close", F.lit(None).cast("double")))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.sector_map(read_table(spark, sf_dir, "supplier"), read_table(spark, sf_dir, "nation"))


def price_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prices`` written once, for queries that derive more than one thing
    from it (one row per security and month)."""
    return cut_lineage(prices(spark, sf_dir))


def universe(spark: SparkSession, sf_dir: str, price_table: DataFrame | None = None,
             min_obs: int = MIN_OBS) -> DataFrame:
    """D1 risk universe: ticker, sector, sigma, mdd, beta.  Pass the price
    table (``price_table``) when the caller also derives latest prices from
    it."""
    p = market.select_price(price_table if price_table is not None else prices(spark, sf_dir))
    return market.ticker_metrics_a(p, sectors(spark, sf_dir), min_obs=min_obs,
                                   periods_per_year=PERIODS_PER_YEAR)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 positions: portfolio_id, ticker, quantity."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .groupBy(F.col("o_custkey").alias("portfolio_id"), F.col("l_suppkey").alias("ticker"))
            .agg(F.sum("l_quantity").alias("quantity")))


def cash_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive account balances as a CASH position at price 1."""
    c = read_table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0)
    return c.select(F.col("c_custkey").alias("portfolio_id"), F.lit("CASH").alias("ticker"),
                    F.col("c_acctbal").cast("double").alias("quantity"))


def latest_prices(spark: SparkSession, sf_dir: str, price_table: DataFrame | None = None) -> DataFrame:
    """Last non-null close per security."""
    p = (price_table if price_table is not None else prices(spark, sf_dir)).where(F.col("close").isNotNull())
    return p.groupBy("ticker").agg(F.max_by("close", "ts").alias("price"), F.max("ts").alias("price_ts"))


def symbol(c) -> F.Column:
    """Security key spelled in letters (0->A ... 9->J): 17 -> 'BH'."""
    col = F.col(c) if isinstance(c, str) else c
    return F.translate(col.cast("string"), "0123456789", "ABCDEFGHIJ")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D13 article table derived from documents."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        headline_of("text").alias("headline"),
        F.col("source").alias("ticker"),
        pubdate_of("doc_id").alias("pubdate"),
        F.col("text").alias("summary"))


def headline_of(text) -> F.Column:
    """First sentence of the first line, trimmed."""
    t = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_extract(t, r"^[^\n.!?]*[.!?]?", 0))


def pubdate_of(doc_id) -> F.Column:
    """Deterministic publish date: epoch minus (doc_id mod 45) days; every
    ninth document (doc_id mod 9 = 4) has no date."""
    k = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    d = F.date_sub(F.lit(NEWS_EPOCH).cast("date"), F.pmod(k, F.lit(45)).cast("int"))
    return F.when(F.pmod(k, F.lit(9)) == 4, F.lit(None).cast("timestamp_ntz")).otherwise(
        d.cast("timestamp_ntz"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("ticker"),
                    F.col("embedding").alias("vec"))


def raw_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landed news CSV as a crawler writes it (display-style column names,
    free-form dates, blank links), derived from documents:

    * ``Query Ticker`` = source, ``Title`` = first sentence, ``Summary`` = text
    * ``Link`` blank for every seventh document, ``Final URL`` set for every fifth
    * ``PubDate`` rendered per language: en 'January 5, 2024 at 3:00 PM',
      de '5-Jan-24', fr ISO with zone, es 'date unknown'; none when
      ``pubdate_of`` gives none.
    """
    return raw_news_from(read_table(spark, sf_dir, "documents"))


def raw_news_from(documents: DataFrame) -> DataFrame:
    """``raw_news`` for any documents DataFrame (batch or stream)."""
    d = documents.select("doc_id", "text", "lang", "source")
    k = F.col("doc_id")
    day = pubdate_of("doc_id")
    pub = (F.when(day.isNull(), F.lit(None).cast("string"))
           .when(F.col("lang") == "en", F.concat(F.date_format(day, "MMMM d, yyyy"), F.lit(" at 3:00 PM")))
           .when(F.col("lang") == "de", F.date_format(day, "d-MMM-yy"))
           .when(F.col("lang") == "fr", F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
           .otherwise(F.lit("date unknown")))
    link = F.when(F.pmod(k, F.lit(7)) == 3, F.lit("  ")).otherwise(
        F.concat(F.lit("https://news.example.com/"), F.col("source"), F.lit("/"), k.cast("string")))
    final = F.when(F.pmod(k, F.lit(5)) == 0, F.concat(F.lit("https://m.example.com/a/"), k.cast("string")))
    return d.select(k.alias("Doc Id"), F.col("source").alias("Query Ticker"),
                    headline_of("text").alias("Title"), link.alias("Link"), final.alias("Final URL"),
                    pub.alias("PubDate"), F.col("text").alias("Summary"), F.col("lang").alias("Lang"))
