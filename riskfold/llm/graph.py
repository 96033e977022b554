"""Connected components by alternating large-star and small-star rounds.

Every vertex keeps links to smaller neighbours only; a round relinks larger
neighbours (large-star) or smaller ones (small-star) to the least neighbour.
Minima are pre-aggregated before the shuffle, joins go through shuffles whose
skewed keys AQE splits, and each round is written to the shared checkpoint
folder, so a lost executor costs one round at most.  Rounds end when nothing
changes (their number grows with the logarithm of the vertices)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.session import cut_lineage


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_least(both), "u").where("v > u and v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """``links`` (u, v: ordered ids) -> (u, v) with v the least id of u's
    component, for every u that is not least itself."""
    links = cut_lineage(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _state(links)
    while seen[0]:
        links = cut_lineage(_small_star(_large_star(links)))
        now = _state(links)
        if now == seen:
            break
        seen = now
    return links
