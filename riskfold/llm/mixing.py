"""Mixing sources to target weights by weighted fair queueing (op 7).

Every document copy (epoch 1, epoch 2, ...) of a source stands in the source's
shuffled queue.  Its virtual finish time is the queue's words up to and
including it, divided by the source's target.  All copies are then ordered by
finish time and taken until the next one would exceed the total budget, so at
every moment sources have received words in proportion to their targets.

Scale: the running sums are two-level.  Queues are cut into 4096 hash buckets
(first three hex digits of the shuffle key), sums per bucket are pre-aggregated,
and only rows inside one (source, epoch, bucket) meet in a task, so a source
with a third of all rows is spread like the others.  The global order is cut
into ranges of virtual time; only the range holding the budget's end is sorted.
The outcome is one cut-off key per (source, epoch); documents are compared with
it where they lie, their texts are never shuffled.

Defined results: a null text has size 0; a null source is a source, last in
order; documents of size 0 take 0; rows that share a doc_id, or have none, are
shuffled each by its text; rows equal in doc_id, source and text are taken or left
together; an empty table gives no rows; columns
other than doc_id, source and text are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskfold.llm.registry import register
from riskfold.llm.words import documents, word_count
from riskfold.session import cut_lineage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
TIME_RANGES = 65536
TEXT_HASH = "__text_hash"  # tells rows apart that share an id or have none


def shuffle_key(epoch: Column | int) -> Column:
    e = F.lit(epoch) if isinstance(epoch, int) else epoch
    return F.substring(F.md5(F.concat_ws(":", F.lit("mix"), e.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                                         F.col(TEXT_HASH))), 1, 16)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                   epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target: weights repeat over the sources in code
    point order; a target stops at ``epochs`` times its source's size and the
    excess goes to the others by weight.  With sources ordered by the level
    (cap / weight) at which they fill, the level of the first unfilled one
    settles all.  One row per source: the ordered windows are that small."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    ranked = (per.withColumn("rank", rank).withColumn("weight", weight)
              .withColumn("cap", F.col("source_size") * float(epochs))
              .withColumn("level", F.col("cap") / F.col("weight"))
              .withColumn("budget", F.sum("source_size").over(everything) * float(share))
              .withColumn("filled", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
              .withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
              .withColumn("common", (F.col("budget") - F.col("filled")) / F.col("open")))
    settled = ranked.withColumn("lambda", F.min(F.when(
        F.col("common") < F.col("level"), F.struct("level", "rank", "common"))).over(everything)["common"])
    return settled.select("source", "source_size", F.when(
        F.col("lambda").isNull() | (F.col("cap") <= F.col("lambda") * F.col("weight")), F.col("cap"))
        .otherwise(F.col("lambda") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS,
        size: Column | None = None) -> DataFrame:
    """``docs`` plus size, source_size, target and copies (0 .. epochs);
    columns of these names are replaced."""
    sized = (docs.drop("source_size", "target", "copies").withColumn("size", word_count("text") if size is None else size)
             .withColumn(TEXT_HASH, F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    # sizes and keys are needed several times: written once, without the texts
    rows = cut_lineage(sized.select("doc_id", "source", "size", TEXT_HASH))
    targets = cut_lineage(source_targets(rows, weights, share, epochs))
    same = lambda a, b, *more: [a["source"].eqNullSafe(b["source"]), *[a[c] == b[c] for c in more]]

    copies = (rows.where("size > 0").select("source", "size", "doc_id", TEXT_HASH, F.explode(F.array(*[F.lit(e) for e in range(1, epochs + 1)])).alias("epoch"))
              .withColumn("key", shuffle_key(F.col("epoch")))
              .withColumn("bucket", F.substring("key", 1, 3)).drop("doc_id", TEXT_HASH))
    sums = copies.groupBy("source", "epoch", "bucket").agg(F.sum("size").alias("size"))
    base = sums.select("source", "epoch", "bucket", (F.coalesce(F.sum("size").over(
        Window.partitionBy("source").orderBy("epoch", "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("base"))
    b = base.withColumnRenamed("source", "b_source").withColumnRenamed("epoch", "b_epoch").withColumnRenamed("bucket", "b_bucket")
    t = targets.select(F.col("source").alias("t_source"), "target")
    local = F.sum("size").over(Window.partitionBy("source", "epoch", "bucket").orderBy("key"))
    timed = (copies.withColumn("local", local)
             .join(b, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("epoch") == F.col("b_epoch")) & (F.col("bucket") == F.col("b_bucket")))
             .join(F.broadcast(t) if _bounded(targets) else t, F.col("source").eqNullSafe(F.col("t_source")))
             .withColumn("finish", (F.col("base") + F.col("local")) / F.col("target"))
             .withColumn("span", F.floor(F.col("finish") * TIME_RANGES))
             .select("source", "epoch", "key", "size", "finish", "span"))
    timed = cut_lineage(timed)
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    spans = (timed.groupBy("span").agg(F.sum("size").alias("size"))
             .withColumn("upto", F.sum("size").over(Window.orderBy("span"))))
    # a row per occupied range of virtual time (at most epochs * TIME_RANGES + 1)
    edge = (spans.where(F.col("upto") > budget)
            .agg(F.min(F.struct("span", (F.col("upto") - F.col("size")).alias("before"))).alias("edge")).first()["edge"])
    if edge is None:
        taken = timed
    else:
        order = Window.orderBy("finish", F.col("source").asc_nulls_last(), "epoch", "key")
        last = (timed.where(F.col("span") == edge["span"])
                .withColumn("total", F.sum("size").over(order) + F.lit(edge["before"]))
                .where(F.col("total") <= budget).drop("total"))
        taken = timed.where(F.col("span") < edge["span"]).unionByName(last)
    cuts = (taken.groupBy("source").agg(*[F.max(F.when(F.col("epoch") == e, F.col("key"))).alias(f"cut{e}") for e in range(1, epochs + 1)]))
    final = cut_lineage(targets.join(cuts.withColumnRenamed("source", "c_source"), F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source")
                        .withColumnRenamed("source", "t_source"))
    mixed = sized.join(F.broadcast(final) if _bounded(final) else final, F.col("source").eqNullSafe(F.col("t_source")), "left")
    count = sum((F.when(shuffle_key(e) <= F.col(f"cut{e}"), 1).otherwise(0) for e in range(1, epochs + 1)), F.lit(0))
    return (mixed.withColumn("copies", F.when(F.col("size") > 0, count).otherwise(0))
            .drop("t_source", TEXT_HASH, *[f"cut{e}" for e in range(1, epochs + 1)]))


def _bounded(small: DataFrame, rows: int = 10_000) -> bool:
    """At most ``rows`` sources (some 100 bytes each): safe to broadcast;
    beyond that the join shuffles and AQE splits large sources."""
    return small.limit(rows + 1).count() <= rows


_ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(text, '')) AS hash FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM per),
l AS (
  SELECT *, cap / weight AS level FROM w),
r AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY level, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY level, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS common FROM l),
s AS (SELECT *, (SELECT common FROM r WHERE common < level ORDER BY level, source ASC NULLS LAST LIMIT 1) AS lam FROM r),
t AS (SELECT source, source_size, CASE WHEN lam IS NULL OR cap <= lam * weight THEN cap ELSE lam * weight END AS target FROM s),
c AS (
  SELECT d.doc_id, d.source, d.size, d.hash, e.epoch,
    substr(md5('mix:' || e.epoch || ':' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || d.hash), 1, 16) AS key
  FROM d, (VALUES (1), (2)) e(epoch) WHERE d.size > 0),
q AS (
  SELECT c.*, sum(c.size) OVER (PARTITION BY c.source ORDER BY c.epoch, c.key) / t.target AS finish
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, source ASC NULLS LAST, epoch, key) AS total FROM q),
k AS (SELECT doc_id, source, hash, sum(size) AS taken FROM g WHERE total <= (SELECT sum(target) FROM t) GROUP BY doc_id, source, hash)
SELECT d.doc_id, d.size, t.source_size, t.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.source IS NOT DISTINCT FROM k.source AND d.hash = k.hash
"""


@register("op7_fair_mix", _ORACLE)
def op7_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "source", "text")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
