"""Exact quantiles without a single buffer holding every value (A4).

Spark's exact ``percentile`` aggregate merges all values into one final
buffer.  Here every size takes the same way:

1. equal values are counted (partial aggregation, so ties of any size are one
   row) and the distinct values are range-partitioned by (column, value);
2. the number of values per range gives the range that holds each wanted rank
   (the driver sees one number per range and column);
3. a running count inside those ranges only picks the values.

A task never holds more than one range of the distinct values.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskfold.session import cut_lineage


def _ranks(n: int, probs) -> list[int]:
    """0-based ranks that linear interpolation at ``probs`` reads."""
    return sorted({r for p in probs for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))})


def _interpolate(at: dict[int, float], n: int, p: float) -> float:
    pos = (n - 1) * p
    lo, hi = math.floor(pos), math.ceil(pos)
    return at[lo] if at[lo] == at[hi] else (hi - pos) * at[lo] + (pos - lo) * at[hi]


def exact_quantiles_multi(df: DataFrame, cols, probs, ranges: int | None = None) -> dict[str, list]:
    """Linear-interpolation quantiles (same definition as ``percentile`` /
    ``quantile_cont``) of several columns of the same rows.  Rows with a null
    or NaN in any of ``cols`` are skipped; no row gives nulls.  ``ranges`` is
    the number of ranges (default: the session's shuffle partitions)."""
    cols = list(cols)
    x = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    for c in cols:
        x = x.where(F.col(c).isNotNull() & ~F.isnan(c))
    counts = (x.select(F.posexplode(F.array(*cols)).alias("i", "v"))
              .groupBy("i", "v").agg(F.count("*").alias("n")))
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: the range bounds are sampled, both passes must see the same
    ranged = cut_lineage(counts.repartitionByRange(ranges, "i", "v").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("i", "part").agg(F.sum("n").alias("n")).orderBy("i", "part").collect()

    n = sum(r["n"] for r in sizes if r["i"] == 0)
    if n == 0:
        return {c: [None for _ in probs] for c in cols}
    wanted, below = [], dict.fromkeys(range(len(cols)), 0)
    for r in sizes:
        start = below[r["i"]]
        wanted += [(r["i"], r["part"], k, k - start) for k in _ranks(n, probs) if start <= k < start + r["n"]]
        below[r["i"]] = start + r["n"]

    marks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("part"), F.lit(k).alias("k"),
                               F.lit(off).alias("off")) for i, p, k, off in wanted])
    upto = F.sum("n").over(Window.partitionBy("i", "part").orderBy("v")
                           .rowsBetween(Window.unboundedPreceding, 0))
    held = ranged.withColumn("marks", F.filter(marks, lambda m: (m["i"] == F.col("i")) & (m["part"] == F.col("part"))))
    picked = (held.where(F.size("marks") > 0).withColumn("upto", upto)
              .select("i", "v", "n", "upto", F.explode("marks").alias("m"))
              .where((F.col("m.off") < F.col("upto")) & (F.col("m.off") >= F.col("upto") - F.col("n")))
              .select("i", "v", F.col("m.k").alias("k")).collect())
    at: dict[int, dict[int, float]] = {}
    for r in picked:
        at.setdefault(r["i"], {})[r["k"]] = r["v"]
    return {c: [_interpolate(at[i], n, p) for p in probs] for i, c in enumerate(cols)}


def exact_quantiles(df: DataFrame, col, probs, ranges: int | None = None) -> list:
    """``exact_quantiles_multi`` of one column."""
    x = df.select((F.col(col) if isinstance(col, str) else col).alias("x"))
    return exact_quantiles_multi(x, ("x",), probs, ranges)["x"]
