"""Positions, prices and weights (S14, P21, P24, P25, F5, F17, M6, W6, W7,
W10, N3-N5, E1, E3, J4, J5, J15, T3, T4).

Positions are aggregated per (portfolio, security) before any per-portfolio
window, so a window partition is bounded by the universe size however many
raw rows a hot portfolio has; the raw-row work is a partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskfold.functions.numbers import round_money

# Fixed value: grammar of one "TICKER QUANTITY" item.
ITEM_PATTERN = r"^([A-Za-z.\-]+)\s+([0-9]*\.?[0-9]+)$"
PIE_SLOTS = 8


def parse_portfolio_text(df: DataFrame, text: str = "raw", pid: str = "portfolio_id") -> DataFrame:
    """S14 + P24 + F5: one row per item of a ``"AAPL 10, MSFT 8"`` text.

    Blank items are dropped; ``ok`` flags grammar matches; ticker is upper
    case with '.' -> '-'; for a ticker listed twice the *last* item wins
    (``keep`` marks the surviving row)."""
    items = df.select(pid, F.posexplode(F.split(F.col(text), ",")).alias("pos", "item"))
    items = items.withColumn("item", F.trim("item")).where(F.col("item") != "")
    ok = F.col("item").rlike(ITEM_PATTERN)
    items = items.withColumn("ok", ok).withColumn(
        "ticker", F.when(ok, F.replace(F.upper(F.regexp_extract("item", ITEM_PATTERN, 1)), F.lit("."), F.lit("-")))
    ).withColumn("quantity", F.when(ok, F.regexp_extract("item", ITEM_PATTERN, 2).cast("double")))
    last = Window.partitionBy(pid, "ticker").orderBy(F.col("pos").desc())
    return items.withColumn("keep", F.col("ok") & (F.row_number().over(last) == 1))


def positions_from_text(parsed: DataFrame, pid: str = "portfolio_id") -> DataFrame:
    """Valid, de-duplicated positions of ``parse_portfolio_text``."""
    return parsed.where("keep").select(pid, "ticker", "quantity")


def portfolio_text(positions: DataFrame, pid: str = "portfolio_id") -> DataFrame:
    """positions -> ``"T 1.00, U 2.00"`` ordered by ticker."""
    s = F.sort_array(F.collect_list(F.struct("ticker", "quantity")))
    txt = F.array_join(F.transform(s, lambda e: F.format_string("%s %.2f", e["ticker"], e["quantity"])), ", ")
    return positions.groupBy(pid).agg(txt.alias("raw"))


def latest_price(quotes: DataFrame, key: str = "ticker", ts: str = "ts", price: str = "price") -> DataFrame:
    """Latest non-null price per key (max_by, partial aggregation)."""
    return (quotes.where(F.col(price).isNotNull())
            .groupBy(key).agg(F.max_by(price, ts).alias("price"), F.max(ts).alias("price_ts")))


def attach_prices(positions: DataFrame, prices: DataFrame, demo: DataFrame | None = None) -> DataFrame:
    """E3 + P21: price every position; a missing (or non-positive) price
    falls back to the demo price table when given (``used_demo``), else
    the row keeps a null price and ``price_ok`` = false (quarantine)."""
    p = prices.select("ticker", F.col("price").alias("_live"))
    j = positions.join(p, "ticker", "left")
    live_ok = F.col("_live").isNotNull() & (F.col("_live") > 0)
    if demo is not None:
        j = j.join(demo.select("ticker", F.col("price").alias("_demo")), "ticker", "left")
        price = F.when(live_ok, F.col("_live")).otherwise(F.col("_demo"))
        used = ~live_ok & F.col("_demo").isNotNull()
        j = j.withColumn("price", price).withColumn("used_demo", used).drop("_demo")
    else:
        j = j.withColumn("price", F.when(live_ok, F.col("_live"))).withColumn("used_demo", F.lit(False))
    return j.drop("_live").withColumn("price_ok", F.col("price").isNotNull() & (F.col("price") > 0))


def weights(priced: DataFrame, pid: str = "portfolio_id") -> DataFrame:
    """M6 + W6 + A13: market value and weight = value / total value.
    Portfolios with a non-positive total are flagged (``value_ok``).

    Positions are unique per (portfolio, security), so a portfolio's window
    partition holds at most one row per security of the universe; the total
    is a window sum (one pass, no self-join of the priced positions)."""
    v = priced.withColumn("market_value", F.col("quantity") * F.col("price"))
    return (v.withColumn("total_value", F.sum("market_value").over(Window.partitionBy(pid)))
            .withColumn("weight", F.when(F.col("total_value") > 0,
                                         F.try_divide(F.col("market_value"), F.col("total_value"))))
            .withColumn("value_ok", F.col("total_value") > 0))


def allocation(w: DataFrame, pid: str = "portfolio_id") -> DataFrame:
    """P25 + T3: rounded allocation rows with their rank by weight desc."""
    rank = Window.partitionBy(pid).orderBy(F.col("weight").desc(), F.col("ticker"))
    return w.select(pid, "ticker", "quantity",
                    F.round("price", 4).alias("price"),
                    round_money("market_value", 2).alias("market_value"),
                    F.round("weight", 4).alias("weight"),
                    F.row_number().over(rank).alias("rank"))


def pie_slices(w: DataFrame, pid: str = "portfolio_id", digits: int = 6) -> DataFrame:
    """Running cumulative share by weight desc: start, end and a cyclic
    colour slot.  A portfolio holds at most one row per security, so the
    window partition is bounded by the universe size."""
    o = Window.partitionBy(pid).orderBy(F.col("weight").desc(), F.col("ticker"))
    run = o.rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("weight").over(run)
    return w.select(pid, "ticker", "weight",
                    end.alias("_end"), F.row_number().over(o).alias("slot_rank")).select(
        pid, "ticker", F.round("weight", digits).alias("weight"),
        F.round(F.col("_end") - F.col("weight"), digits).alias("slice_start"),
        F.round("_end", digits).alias("slice_end"),
        ((F.col("slot_rank") - 1) % PIE_SLOTS).cast("int").alias("color_slot"))


def sector_exposure(w: DataFrame, universe: DataFrame, pid: str = "portfolio_id",
                    digits: int = 4) -> DataFrame:
    """A2 + N3 + T4: sector -> weight map per portfolio, entries sorted by
    weight desc, plus the same as a long table (sector, weight, rank)."""
    j = w.join(universe.select("ticker", "sector"), "ticker", "left").withColumn(
        "sector", F.coalesce("sector", F.lit("Unknown")))
    s = j.groupBy(pid, "sector").agg(F.sum("weight").alias("sector_weight"))
    return s.select(pid, "sector", F.round("sector_weight", digits).alias("sector_weight"))


def sector_map_column(exposure: DataFrame, pid: str = "portfolio_id") -> DataFrame:
    """One map<sector, weight> per portfolio (bounded by sector count)."""
    return exposure.groupBy(pid).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("sector", "sector_weight")))).alias("sectors"))


def missing_tickers(positions: DataFrame, universe: DataFrame, pid: str = "portfolio_id") -> DataFrame:
    """J5 + U3 + E1: held tickers absent from the universe (quarantine rows)."""
    return positions.select(pid, "ticker").join(universe.select("ticker"), "ticker", "left_anti")


def holdings(w: DataFrame, universe: DataFrame, pid: str = "portfolio_id", digits: int = 4) -> DataFrame:
    """J4 + J15 + P25 + T4: universe rows of the held tickers with weight,
    missing metrics default to 0, rank by weight desc."""
    j = w.select(pid, "ticker", "weight").join(universe, "ticker", "inner")
    rank = Window.partitionBy(pid).orderBy(F.col("weight").desc(), F.col("ticker"))
    return j.select(pid, "ticker", F.round("weight", digits).alias("weight"), "sector",
                    *[F.round(F.coalesce(c, F.lit(0.0)), digits).alias(c) for c in ("sigma", "mdd", "beta")],
                    F.row_number().over(rank).alias("rank"))


def upsert_positions(current: DataFrame, changes: DataFrame, pid: str = "portfolio_id") -> DataFrame:
    """Add or replace one position per (portfolio, ticker): remove the
    old row, append the new one (anti-join + union)."""
    keep = current.join(changes.select(pid, "ticker"), [pid, "ticker"], "left_anti")
    return keep.unionByName(changes.select(*current.columns))


def remove_positions(current: DataFrame, removals: DataFrame, pid: str = "portfolio_id") -> DataFrame:
    """Drop the listed (portfolio, ticker) positions."""
    return current.join(removals.select(pid, "ticker"), [pid, "ticker"], "left_anti")


def edit_positions(current: DataFrame, changes: DataFrame, removals: DataFrame, pid: str = "portfolio_id") -> DataFrame:
    """N4 + N5 in one pass: changes replace or add, removals drop (a position
    in both goes).  Each of the three holds a position at most once; one
    aggregation by (portfolio, ticker) takes the place of two anti-joins."""
    rows = (current.select(pid, "ticker", "quantity", F.lit(0).alias("_edit"))
            .unionByName(changes.select(pid, "ticker", "quantity", F.lit(1).alias("_edit")))
            .unionByName(removals.select(pid, "ticker", F.lit(None).cast("double").alias("quantity"), F.lit(2).alias("_edit"))))

    def of(edit):
        return F.max(F.when(F.col("_edit") == edit, F.col("quantity")))

    last = rows.groupBy(pid, "ticker").agg(of(0).alias("_old"), of(1).alias("_new"), F.max("_edit").alias("_edit"))
    return last.where(F.col("_edit") < 2).select(
        pid, "ticker", F.when(F.col("_edit") == 1, F.col("_new")).otherwise(F.col("_old"))
        .cast(current.schema["quantity"].dataType).alias("quantity"))


def named_portfolios(docs: DataFrame, col: str = "doc", pid: str = "investor") -> DataFrame:
    """``{"<investor>": {"<ticker>": weight, ...}, ...}`` documents ->
    long rows (investor, ticker, weight) with two explodes."""
    m = F.from_json(F.col(col), "map<string, map<string, double>>")
    outer = docs.select(F.explode(m).alias(pid, "_w"))
    return outer.select(pid, F.explode("_w").alias("ticker", "weight"))
