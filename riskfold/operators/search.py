"""Ticker search ranking (T8, T10) as equi-joins on a substring index.

Instead of scoring every (query, option) pair, every option is indexed by
all substrings of its (short) ticker and sector texts with the best score
each substring can earn (0 exact, 1 prefix, 2 contained, 3 contained in
sector).  A query then finds its candidates with one equi-join on the
substring; the index grows with the universe (length^2 per option, and the
texts are short), never with the number of queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskfold.session import broadcast_if_small


def _substrings(text: F.Column) -> F.Column:
    n = F.length(text)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    return F.flatten(F.transform(starts, lambda s: F.transform(
        F.sequence(F.lit(1), F.greatest(n - s + 1, F.lit(1))),
        lambda ln: F.struct(s.alias("start"), F.substring(text, s, ln).alias("sub")))))


def substring_index(options: DataFrame, ticker: str = "ticker", sector: str = "sector", asked: DataFrame | None = None) -> DataFrame:
    """(ticker, sector, sub, score) with the best score per substring; with
    ``asked`` (distinct ``sub``) only of those."""
    t = F.lower(F.col(ticker))
    s = F.lower(F.coalesce(F.col(sector).cast("string"), F.lit("")))
    tick = options.select(ticker, sector, F.explode(_substrings(t)).alias("e")).select(
        ticker, sector, F.col("e.sub").alias("sub"),
        F.when(F.col("e.sub") == F.lower(F.col(ticker)), 0).when(F.col("e.start") == 1, 1).otherwise(2).alias("score"))
    sect = options.select(ticker, sector, F.explode(_substrings(s)).alias("e")).select(
        ticker, sector, F.col("e.sub").alias("sub"), F.lit(3).alias("score"))
    every = tick.unionByName(sect).where(F.col("sub") != "")
    return ((every if asked is None else every.join(asked, "sub"))
            .groupBy(ticker, sector, "sub").agg(F.min("score").alias("score")))


def rank_matches(queries: DataFrame, options: DataFrame, qid: str = "query_id", text: str = "query",
                 k: int = 8) -> DataFrame:
    """Candidates per query by score then ticker; top ``k`` (the feature's
    limit).  T10: ``rank == 1`` is the resolved symbol (an exact match
    always ranks first)."""
    q = _asked(queries, qid, text)
    return q.join(_ranked(q, options, k), "sub").select(qid, text, "ticker", "sector", "score", "rank")


def _asked(queries: DataFrame, qid: str, text: str) -> DataFrame:
    return queries.select(qid, text, F.lower(F.trim(text)).alias("sub")).where(F.col("sub") != "")


def _ranked(q: DataFrame, options: DataFrame, k: int) -> DataFrame:
    """The top ``k`` of every distinct ``sub`` of ``q``: a hot text is ranked
    once, and the index keeps only substrings that were asked for."""
    idx = substring_index(options, asked=broadcast_if_small(q.select("sub").distinct()))
    w = Window.partitionBy("sub").orderBy("score", "ticker")
    return broadcast_if_small(idx.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))


def resolve(queries: DataFrame, options: DataFrame, qid: str = "query_id", text: str = "query") -> DataFrame:
    """The symbol each typed text stands for: the exact match, else the
    best-ranked one, else none.

    Queries meet the ranked texts, which are few, and are not joined to
    themselves; only those whose id comes more than once are matched by id."""
    q = queries.select(qid, text)
    ranked = _ranked(_asked(q, qid, text), options, 1)
    top = ranked.select("sub", F.col("ticker").alias("resolved"), (F.col("score") == 0).alias("exact"))
    found = q.withColumn("sub", F.lower(F.trim(text))).join(top, "sub", "left").withColumn("exact", F.coalesce("exact", F.lit(False)))
    repeated = broadcast_if_small(q.where(F.col(qid).isNotNull()).groupBy(qid).count().where("count > 1").select(qid))
    known = F.col(qid).isNotNull()
    single = found.join(repeated, qid, "left_anti").select(
        qid, text, F.when(known, F.col("resolved")).alias("resolved"), (known & F.col("exact")).alias("exact"))
    again = q.join(repeated, qid, "left_semi")
    best = _asked(again, qid, text).join(ranked, "sub").select(qid, F.col("ticker").alias("resolved"), (F.col("score") == 0).alias("exact"))
    return single.unionByName(again.join(best, qid, "left").withColumn("exact", F.coalesce("exact", F.lit(False))))
