"""Portfolio risk scoring.

``score_portfolios`` scores *every* portfolio of a long weight table in one
plan.  Per-portfolio sums are plain aggregations (map-side partial
aggregation, so a portfolio holding a third of all rows is pre-combined
before the shuffle).  Universe statistics (quartiles, mean / std) are scalar
subqueries over the universe, which has one row per security; no cross
join is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfold.functions.numbers import clip
from riskfold.operators.stats import exact_quantiles_multi
from riskfold.session import cut_lineage

# Fixed values of the reference score.
WEIGHTS_V1 = {"sigma": 0.35, "mdd": 0.25, "beta": 0.20, "hhi": 0.10}
WEIGHTS_V2 = {"sigma": 0.30, "mdd": 0.25, "beta": 0.20, "hhi": 0.15, "cash": 0.05}
SAFE_BELOW = 0.33
NEUTRAL_BELOW = 0.66
UNKNOWN_SECTOR = "Unknown"


def r0(c, digits: int) -> Column:
    """Round and turn a negative zero into 0.0 (stable text / hash form)."""
    return F.round(c, digits) + F.lit(0.0)


def category(score: Column) -> Column:
    """SAFE < 0.33 <= NEUTRAL < 0.66 <= AGGRESSIVE (NaN/null -> AGGRESSIVE)."""
    return (F.when(score < SAFE_BELOW, F.lit("SAFE"))
            .when(score < NEUTRAL_BELOW, F.lit("NEUTRAL"))
            .otherwise(F.lit("AGGRESSIVE")))


def universe_quartiles(universe: DataFrame) -> Column:
    """A4: exact (linear interpolation) q1 / median / q3 of sigma, |mdd| and
    beta as a struct column."""
    metrics = universe.select("sigma", F.abs(F.col("mdd")).alias("mdd"), "beta")
    found = exact_quantiles_multi(metrics, metrics.columns, (0.25, 0.5, 0.75))
    return F.struct(*[F.array(*[F.lit(v).cast("double") for v in found[c]]).alias(c) for c in metrics.columns])


def robust_z(value: Column, q: Column) -> Column:
    """A5: clip((v - median) / (q3 - q1), -3, 3); 0 when the IQR is 0."""
    q1, med, q3 = q.getItem(0), q.getItem(1), q.getItem(2)
    iqr = q3 - q1
    return F.when(iqr == 0, F.lit(0.0)).otherwise(clip(F.try_divide(value - med, iqr), -3.0, 3.0))


def portfolio_aggregates(weights: DataFrame, universe: DataFrame,
                         pid: str = "portfolio_id") -> DataFrame:
    """Weighted sigma / mdd / beta over the matched tickers
    (normalised by matched weight) and sector HHI over *all* raw weights
    (unmatched tickers count under sector 'Unknown')."""
    u = universe.select("ticker", "sector", "sigma", "mdd", "beta").withColumn("_m", F.lit(True))
    j = weights.select(pid, "ticker", "weight").join(u, "ticker", "left")
    m = F.col("_m").isNotNull()
    # Sector is a function of the ticker, so aggregating by (portfolio, sector)
    # first and then by portfolio gives the same sums; the second shuffle only
    # moves one row per (portfolio, sector).
    by_sector = j.groupBy(pid, F.coalesce("sector", F.lit(UNKNOWN_SECTOR)).alias("sector")).agg(
        F.sum("weight").alias("sw"),
        F.sum(F.when(m, F.col("weight"))).alias("mw"),
        F.sum(F.when(m, F.col("weight") * F.col("sigma"))).alias("ws"),
        F.sum(F.when(m, F.col("weight") * F.col("mdd"))).alias("wm"),
        F.sum(F.when(m, F.col("weight") * F.col("beta"))).alias("wb"),
        F.count(F.when(m, 1)).alias("nm"),
        F.count("*").alias("n"))
    agg = by_sector.groupBy(pid).agg(
        F.sum("mw").alias("matched_weight"), F.sum("ws").alias("ws"), F.sum("wm").alias("wm"),
        F.sum("wb").alias("wb"), F.sum("nm").alias("n_matched"), F.sum("n").alias("n_listed"),
        F.sum(F.col("sw") * F.col("sw")).alias("hhi"))
    return agg.select(
        pid, "n_matched", "n_listed", "matched_weight", "hhi",
        F.try_divide(F.col("ws"), F.col("matched_weight")).alias("sigma_p"),
        F.try_divide(F.col("wm"), F.col("matched_weight")).alias("mdd_p"),
        F.try_divide(F.col("wb"), F.col("matched_weight")).alias("beta_p"))


def score_portfolios(weights: DataFrame, universe: DataFrame, pid: str = "portfolio_id",
                     mdd_sign: float = -1.0, digits: int = 4, quartiles: Column | None = None) -> DataFrame:
    """A14 + A16 + A17: score variant 1 for every portfolio.

    ``mdd_sign=-1`` keeps the reference's negated drawdown term.  The HHI
    z-score is taken against a constant series, whose IQR is 0, so it is
    always 0 (kept as the term ``0.10 * 0``).  Portfolios with no matched
    ticker get null scores and an ``error`` text.  ``quartiles`` overrides
    the universe statistics (struct of sigma / mdd / beta arrays)."""
    # The universe (one row per security) feeds the join and the quartile
    # subquery: materialise it once (reliable checkpoint, shared folder).
    universe = cut_lineage(universe)
    q = quartiles if quartiles is not None else universe_quartiles(universe)
    a = portfolio_aggregates(weights, universe, pid)
    zs = robust_z(F.col("sigma_p"), q.getField("sigma"))
    zm = robust_z(F.abs(F.col("mdd_p")), q.getField("mdd"))
    zb = robust_z(F.col("beta_p"), q.getField("beta"))
    srisk = (WEIGHTS_V1["sigma"] * zs + mdd_sign * WEIGHTS_V1["mdd"] * zm
             + WEIGHTS_V1["beta"] * zb + WEIGHTS_V1["hhi"] * F.lit(0.0))
    ok = F.col("n_matched") > 0
    return a.select(
        pid,
        F.when(ok, r0(srisk, digits)).alias("srisk"),
        F.when(ok, category(srisk)).alias("category"),
        F.when(ok, r0(F.col("sigma_p"), digits)).alias("sigma_p"),
        F.when(ok, r0(F.col("mdd_p"), digits)).alias("mdd_p"),
        F.when(ok, r0(F.col("beta_p"), digits)).alias("beta_p"),
        F.when(ok, r0(F.col("hhi"), digits)).alias("hhi"),
        F.when(~ok, F.lit("no ticker of the portfolio is in the universe")).alias("error"))


def score_portfolios_v2(weights: DataFrame, universe: DataFrame, pid: str = "portfolio_id",
                        cash_ticker: str = "CASH", digits: int = 4) -> DataFrame:
    """Variant 2.  Unmatched tickers are skipped, a CASH
    position becomes a zero-metric asset in sector 'Cash', z-scores are
    mean/std (ddof 1, 0 when std is 0) and the HHI is scored against the
    per-sector (n_s / N)^2 distribution of the universe."""
    universe = cut_lineage(universe)   # used by the join and four subqueries
    u = universe.select("ticker", "sector", "sigma", "mdd", "beta")
    w = weights.select(pid, "ticker", "weight")
    held = w.join(u, "ticker", "inner")
    cash = (w.where(F.col("ticker").cast("string") == cash_ticker)
            .select(pid, "ticker", "weight", F.lit("Cash").alias("sector"),
                    F.lit(0.0).alias("sigma"), F.lit(0.0).alias("mdd"), F.lit(0.0).alias("beta")))
    pf = held.select(pid, "ticker", "weight", "sector", "sigma", "mdd", "beta").unionByName(cash)
    by_sector = pf.groupBy(pid, "sector").agg(
        F.sum("weight").alias("sw"),
        F.sum(F.col("weight") * F.col("sigma")).alias("ws"),
        F.sum(F.col("weight") * F.col("mdd")).alias("wm"),
        F.sum(F.col("weight") * F.col("beta")).alias("wb"),
        F.sum(F.when(F.col("ticker").cast("string") == cash_ticker, F.col("weight")).otherwise(0.0)).alias("cw"))
    a = by_sector.groupBy(pid).agg(
        F.sum("sw").alias("tw"), F.sum("ws").alias("ws"), F.sum("wm").alias("wm"),
        F.sum("wb").alias("wb"), F.sum("cw").alias("cash_p"),
        F.sum(F.col("sw") * F.col("sw")).alias("hhi"))
    a = a.select(pid, "hhi", "cash_p",
                 F.try_divide(F.col("ws"), F.col("tw")).alias("sigma_p"),
                 F.abs(F.try_divide(F.col("wm"), F.col("tw"))).alias("mdd_p"),
                 F.try_divide(F.col("wb"), F.col("tw")).alias("beta_p"))
    n = universe.select(F.count("*")).scalar()
    stats = universe.select(F.struct(
        F.avg("sigma").alias("ms"), F.stddev_samp("sigma").alias("ss"),
        F.avg(F.abs(F.col("mdd"))).alias("mm"), F.stddev_samp(F.abs(F.col("mdd"))).alias("sm"),
        F.avg("beta").alias("mb"), F.stddev_samp("beta").alias("sb"))).scalar()
    share = universe.groupBy("sector").agg(F.count("*").alias("k")).select(
        F.pow(F.col("k") / n, 2).alias("s2"))
    hstats = share.select(F.struct(F.avg("s2").alias("m"), F.stddev_samp("s2").alias("s"))).scalar()

    def z(v, mean, sd):
        return F.when(F.coalesce(sd, F.lit(0.0)) > 0, (v - mean) / sd).otherwise(F.lit(0.0))

    srisk = (WEIGHTS_V2["sigma"] * z(F.col("sigma_p"), stats.getField("ms"), stats.getField("ss"))
             + WEIGHTS_V2["mdd"] * z(F.col("mdd_p"), stats.getField("mm"), stats.getField("sm"))
             + WEIGHTS_V2["beta"] * z(F.col("beta_p"), stats.getField("mb"), stats.getField("sb"))
             + WEIGHTS_V2["hhi"] * z(F.col("hhi"), hstats.getField("m"), hstats.getField("s"))
             - WEIGHTS_V2["cash"] * F.col("cash_p"))
    return a.select(pid, r0(srisk, digits).alias("srisk"), category(srisk).alias("category"),
                    r0(F.col("sigma_p"), digits).alias("sigma_p"), r0(F.col("mdd_p"), digits).alias("mdd_p"),
                    r0(F.col("beta_p"), digits).alias("beta_p"), r0(F.col("hhi"), digits).alias("hhi"),
                    r0(F.col("cash_p"), digits).alias("cash_p"))


def top_by(universe: DataFrame, col: str = "sigma", n: int = 12, digits: int = 4) -> DataFrame:
    """Top n securities by a metric (TakeOrderedAndProject, no full sort)."""
    return (universe.orderBy(F.col(col).desc(), F.col("ticker"))
            .limit(n)
            .select("ticker", "sector", *[F.round(c, digits).alias(c) for c in ("sigma", "mdd", "beta")]))
