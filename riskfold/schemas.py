"""Schemas of the logical data sets and schema-level transforms (P9-P12,
U5, E2, E4, A18).  Everything here works on column *names* (metadata) or
builds projections; no data passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold.functions.text import snake_name

D = T.DoubleType()
S = T.StringType()

UNIVERSE_SCHEMA = T.StructType([T.StructField("ticker", S), T.StructField("sector", S),
                                T.StructField("sigma", D), T.StructField("mdd", D), T.StructField("beta", D)])

SCORE_SCHEMA = T.StructType([T.StructField("investor", S), T.StructField("category", S), T.StructField("srisk", T.DoubleType())])
ARTICLE_SCHEMA = T.StructType([T.StructField("id", S), T.StructField("headline", S), T.StructField("ticker", S),
                               T.StructField("pubdate", T.TimestampNTZType()), T.StructField("summary", S)])

LINK_SCHEMA = T.StructType([T.StructField(c, S) for c in
                            ("ticker", "link", "headline", "pubdate", "related_tickers", "article")])

BLOCK_SCHEMA = T.StructType([T.StructField("ticker", S), T.StructField("link", S)])

# The fundamentals record (3 text + 20 numeric columns).
FUNDAMENTAL_NUMERIC = (
    "Profit Margin", "Operating Margin (ttm)", "Return on Assets(ROA) (ttm)", "Return on Equity(ROE) (ttm)",
    "Revenue (ttm)", "Revenue Per Share (ttm)", "Quarterly Revenue Growth (yoy)", "Gross Profit (ttm)",
    "EBITDA", "Net Income Avi to Common (ttm)", "Diluted EPS (ttm)", "Quarterly Earnings Growth (yoy)",
    "Total Cash (mrq)", "Total Cash Per Share (mrq)", "Total Debt (mrq)", "Total Debt/Equity (mrq)",
    "Current Ratio (mrq)", "Book Value Per Share (mrq)", "Operating Cash Flow (ttm)",
    "Levered Free Cash Flow (ttm)")
FUNDAMENTALS_SCHEMA = T.StructType([T.StructField("Ticker", S), T.StructField("Sector", S),
                                    T.StructField("Industry", S)]
                                   + [T.StructField(c, D) for c in FUNDAMENTAL_NUMERIC])

# Alias pairs applied only when the canonical column is absent.
NEWS_ALIASES = (("ticker", "query_ticker"), ("headline", "title"), ("pubdate", "provider_publish_time"))


def snake_columns(df: DataFrame) -> DataFrame:
    """P10: rename every column to snake case."""
    return df.toDF(*[snake_name(c) for c in df.columns])


def apply_news_aliases(df: DataFrame) -> DataFrame:
    """Copy an alias column into the canonical name when it is missing."""
    for canon, alias in NEWS_ALIASES:
        if canon not in df.columns and alias in df.columns:
            df = df.withColumn(canon, F.col(alias))
    return df


def url_columns(df: DataFrame) -> list[str]:
    """URL-like columns in priority order: final_url, url, link, href, then
    any other name containing url / link / href."""
    like = [c for c in df.columns if "url" in c or "link" in c or "href" in c]
    first = [c for c in ("final_url", "url", "link", "href") if c in like]
    return first + [c for c in like if c not in first]


def require_columns(df: DataFrame, cols) -> None:
    """Required-column check (metadata only)."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def has_columns(df: DataFrame, cols) -> bool:
    """Subset test on column names."""
    return set(cols) <= set(df.columns)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project onto ``schema``: cast present columns, add missing ones
    as typed nulls, drop the rest, fixed order."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def intersect_columns(df: DataFrame, target_cols) -> DataFrame:
    """Keep only the columns that the target also has."""
    return df.select(*[c for c in df.columns if c in set(target_cols)])


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """Raise when a result is empty (one cheap ``isEmpty`` probe)."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df
