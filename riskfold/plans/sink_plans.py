"""Sink / source round trips."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from riskfold.functions.numbers import fmt_fixed
from riskfold.plans import bindings as B
from riskfold.plans import sql_fragments as S
from riskfold.plans.catalog import register
from riskfold.session import checkpoint_dir
from riskfold.sources import files


def _folder(spark, name):
    return os.path.join(checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex[:12]}")


@register("q_csv_roundtrip", sql=f"""
WITH {S.UNIVERSE}
SELECT CAST(ticker AS VARCHAR) AS ticker, sector, sigma, mdd, beta FROM universe""")
def q_csv_roundtrip(spark, sf):
    """K1 + S1 + S2 + S5: the universe written as CSV (metrics as text with a
    percent sign) and scanned back through the first-number cleaner."""
    root = _folder(spark, "csv")
    u = B.universe(spark, sf)
    out = u.select(F.col("ticker").cast("string").alias("ticker"), "sector",
                   *[F.concat(F.format_string("%.6f", c), F.lit("%")).alias(c) for c in ("sigma", "mdd", "beta")])
    files.write_csv(out, f"{root}/universe")
    path = files.first_with_columns(spark, [f"{root}/missing", f"{root}/universe"],
                                    {"ticker", "sigma", "mdd", "beta", "sector"})
    return files.load_universe(spark, path)


@register("q_jsonl_roundtrip", sql=f"""
WITH {S.UNIVERSE}
SELECT DISTINCT translate(CAST(ticker AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS ticker FROM universe""")
def q_jsonl_roundtrip(spark, sf):
    """K7 + K14 + S13: allocation rows as JSON lines and the ticker-list
    cache with its age check, read back."""
    root = _folder(spark, "jsonl")
    u = B.universe(spark, sf).select(B.symbol("ticker").alias("ticker"), "sector",
                                     fmt_fixed("sigma", 4).alias("sigma_txt"))
    files.write_jsonl(u, f"{root}/rows")
    rows = files.read_jsonl(spark, f"{root}/rows", u.schema)
    files.save_ticker_cache(rows, f"{root}/cache", B.AS_OF)
    return files.load_ticker_cache(spark, f"{root}/cache", B.AS_OF, max_age_days=85)


@register("q_snapshot", sql=f"""
WITH {S.ARTICLES}
SELECT id, ticker, strftime(pubdate, '%Y-%m-%d') AS pubdate, pubdate IS NOT NULL AS in_snapshot FROM arts""")
def q_snapshot(spark, sf):
    """K8 + K10 + K13: the article table written twice; the current version and
    what the version before it held."""
    root = _folder(spark, "snapshot")
    a = B.articles(spark, sf).select("id", "ticker", F.date_format("pubdate", "yyyy-MM-dd").alias("pubdate"))
    files.snapshot_then_overwrite(a.where(F.col("pubdate").isNotNull()), root)
    store = files.snapshot_then_overwrite(a, root)
    before, now = (store.read("current", v) for v in store.history()[-2:])
    return now.join(before.select("id", F.lit(True).alias("in_snapshot")), "id", "left").select(
        "id", "ticker", "pubdate", F.coalesce("in_snapshot", F.lit(False)).alias("in_snapshot"))
