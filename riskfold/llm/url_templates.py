"""URL filter by a path-template tree (op 5), DataFrame operations only.

Rules (host suffix and path prefix, the longest wins) decide what they fit.
The other pages are judged by templates learned per host:

1. Runs of digits in a segment become {n}, long hexadecimal ones {h} (a literal
   \\ * { or | gets a \\ before it); pages are counted by (host, shape) first, so
   the tree works on counts.
2. Level by level from the root, a node with more than MOST_BRANCHES children
   keeps the frequent ones (COMMON of the node's pages or more) and turns the
   others into the wildcard *.
3. Sibling branches whose labelled shares do not differ significantly (two
   proportions, |z| < Z) become one branch; siblings are compared in order of
   their share, each with its neighbour.  Branches with fewer than
   LEAST_LABELLED labelled pages are left alone: there is nothing to compare.
4. A template is rejected when its smoothed purity, (bad + PRIOR * prior share)
   / (labelled + PRIOR), is REJECT or more.  The prior share is the overall bad
   share, one half at most, so a template without labels of its own cannot get
   there and unknown parts of a host stay allowed.

Labels are the pages that rules decide, or a table (page_id, bad) if given.

Scale: pages are pre-aggregated to shapes, all tables of the tree are counts
keyed by (host, prefix); a host with a third of all pages is many prefixes, and
joins back to pages are plain equi-joins that AQE splits or broadcasts by
measured size.  A round takes every node over all segments that its shapes
share and then over one level with a choice, and is written to the checkpoint
folder: rounds are as many as the branching nodes on a path, not as its segments.

Defined results: a null url or one without :// has empty host and path, fits no
rule and is allowed; repeated rows are judged each; an empty table gives no
rows; other columns are carried along (columns named like results are replaced).
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskfold.llm.registry import register
from riskfold.session import cut_lineage

BLOCK, ALLOW = "block", "allow"
# fixed values: the query's rules
RULES = ((BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/"))
MOST_BRANCHES = 20
COMMON = 0.02
LEAST_LABELLED = 5
Z = 1.96
PRIOR = 4.0
REJECT = 0.8


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, or null."""
    fits = []
    for verdict, rule in rules:
        cut = rule.index("/")
        suffix, prefix = rule[:cut], rule[cut:]
        ok = ((host == suffix) | host.endswith(f".{suffix}")) & path.startswith(prefix)
        fits.append(F.when(ok, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def shape_of(path: Column) -> Column:
    """Array of the path's segments with their variable parts as marks."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    plain = F.transform(parts, lambda s: F.regexp_replace(s, r"([\\*{|])", r"\\$1"))
    hexed = F.transform(plain, lambda s: F.regexp_replace(s, r"(?i)\b(?=[0-9a-f]*[0-9])[0-9a-f]{8,}\b", "{h}"))
    return F.transform(hexed, lambda s: F.regexp_replace(s, "[0-9]+", "{n}"))


def _merged(children: DataFrame) -> DataFrame:
    """(host, prefix, branch, joint): ``joint`` names the group of similar siblings."""
    told = children.where(F.col("labelled") >= LEAST_LABELLED)
    order = Window.partitionBy("host", "prefix").orderBy("share", "branch")
    group = Window.partitionBy("host", "prefix", "group")
    before = lambda c: F.lag(c).over(order)
    pooled = (F.col("bad") + before("bad")) / (F.col("labelled") + before("labelled"))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / before("labelled")))
    far = (F.col("share") - before("share")) >= Z * error
    # equal shares differ by 0 with an error of 0 at the ends: never apart
    apart = F.when(before("share").isNull() | (far & (F.col("share") > before("share"))), 1).otherwise(0)
    return (told.withColumn("share", F.col("bad") / F.col("labelled")).withColumn("apart", apart)
            .withColumn("group", F.sum("apart").over(order))
            # at most MOST_BRANCHES + 1 / COMMON + 1 siblings
            .withColumn("names", F.sort_array(F.collect_list("branch").over(group)))
            .select("host", "prefix", "branch", F.array_join("names", "|").alias("joint")))


def _common(a: Column, b: Column) -> Column:
    """Number of leading elements that two arrays share."""
    n = F.least(F.size(a), F.size(b))
    apart = F.array_position(F.transform(F.sequence(F.lit(0), n), lambda i: F.coalesce(F.get(a, i) == F.get(b, i), F.lit(False))), False)
    return (apart - 1).cast("int")


def _onward(tree: DataFrame) -> DataFrame:
    """Every row taken as far as all open shapes of its node share their
    segments: where a node has one child there is nothing to keep or to merge.
    The least and the greatest shape share what all of them share."""
    rest = F.slice("shape", F.col("at") + 1, F.size("shape") - F.col("at"))
    still = tree.where(F.size("shape") > F.col("at"))
    ends = still.groupBy("host", "prefix").agg(F.min(rest).alias("lo"), F.max(rest).alias("hi"))
    step = still.join(ends.select("host", "prefix", _common(F.col("lo"), F.col("hi")).alias("step")), ["host", "prefix"])
    walked = F.transform(F.slice("shape", F.col("at") + 1, F.col("step")), lambda s: F.concat(F.lit("/"), s))
    step = step.withColumn("prefix", F.concat("prefix", F.array_join(walked, ""))).withColumn("at", F.col("at") + F.col("step"))
    return step.select(tree.columns).unionByName(tree.where(F.size("shape") <= F.col("at")))


def templates(shapes: DataFrame) -> DataFrame:
    """``shapes`` (host, shape, pages, labelled, bad) plus template."""
    tree = shapes.withColumn("prefix", F.lit("")).withColumn("at", F.lit(0))
    node = ["host", "prefix"]
    while True:
        tree = cut_lineage(_onward(tree))
        here = tree.where(F.size("shape") > F.col("at")).withColumn("seg", F.get("shape", F.col("at")))
        if here.isEmpty():
            return tree.drop("at").withColumnRenamed("prefix", "template")
        children = here.groupBy(*node, "seg").agg(*(F.sum(c).alias(c) for c in ("pages", "labelled", "bad")))
        nodes = children.groupBy(*node).agg(F.count("*").alias("branches"), F.sum("pages").alias("total"))
        rare = (F.col("branches") > MOST_BRANCHES) & (F.col("pages") < COMMON * F.col("total"))
        named = cut_lineage(children.join(nodes, node).withColumn("branch", F.when(rare, F.lit("*")).otherwise(F.col("seg"))))
        branches = named.groupBy(*node, "branch").agg(*(F.sum(c).alias(c) for c in ("labelled", "bad")))
        names = (named.select(*node, "seg", "branch").join(_merged(branches), [*node, "branch"], "left")
                 .select(*node, "seg", F.coalesce("joint", "branch").alias("name")))
        moved = (here.join(names, [*node, "seg"]).withColumn("prefix", F.concat("prefix", F.lit("/"), "name"))
                 .withColumn("at", F.col("at") + 1).select(tree.columns))
        tree = moved.unionByName(tree.where(F.size("shape") <= F.col("at")))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """``pages`` plus host, path, rule, verdict, template, purity."""
    result = ("host", "path", "rule", "verdict", "template", "purity")
    others = [c for c in pages.columns if c not in result]
    told = (pages.select(*others).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
            .withColumn("__fit", fitting_rule(F.col("host"), F.col("path"), rules))
            .withColumn("__shape", shape_of(F.col("path"))))
    if labels is None:
        marked = told.withColumn("__bad", F.when(F.col("__fit").isNotNull(), (F.col("__fit.verdict") == BLOCK).cast("int")))
    else:
        given = labels.groupBy(F.col("page_id").alias("__page")).agg(F.max(F.col("bad").cast("int")).alias("__bad"))
        marked = told.join(given, F.col("page_id") == F.col("__page"), "left").drop("__page")
    shapes = marked.groupBy("host", F.col("__shape").alias("shape")).agg(
        F.count("*").alias("pages"), F.count("__bad").alias("labelled"), F.coalesce(F.sum("__bad"), F.lit(0)).alias("bad"))
    tree = templates(shapes)
    overall = min(0.5, tree.agg(F.try_divide(F.sum("bad"), F.sum("labelled"))).first()[0] or 0.0)
    purity = (F.sum("bad") + PRIOR * overall) / (F.sum("labelled") + PRIOR)
    scored = tree.groupBy("host", "template").agg(purity.alias("purity"))
    by_shape = (tree.select("host", "shape", "template").join(scored, ["host", "template"])
                .select(F.col("host").alias("__host"), F.col("shape").alias("__s"), "template", "purity"))
    out = told.join(by_shape, (F.col("host") == F.col("__host")) & (F.col("__shape") == F.col("__s")), "left")
    own = F.when(F.col("purity") >= REJECT, BLOCK).otherwise(ALLOW)
    return out.select(*others, "host", "path", F.col("__fit.rule").alias("rule"),
                      F.coalesce(F.col("__fit.verdict"), own).alias("verdict"), "template", "purity")


@register("op5_url_templates")
def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 9).alias("purity"))
