"""Target-distribution importance resampling (op 13).

Features are runs of 1 to ``ngram`` words hashed into ``buckets``; a bucket's
gain is the log ratio of its smoothed share in the target texts to that in the
documents, a document's weight the floored mean of its features' gains.  The
gains are one array that every task indexes with the feature array of a slice
of texts.  A Gumbel draw from the id is added, and the highest scores of the
documents with enough words are drawn (sampling without replacement in
proportion to exp(weight / 1000)).

Ranks come from parallel sorting by regular sampling:

1. the scored rows are written once; every partition of them is sorted where
   it lies (a run) and gives ``RUN_SAMPLES`` keys at regular places, each
   standing for its share of the run;
2. the runs' samples are merged in ``SAMPLE_GROUPS`` groups, each resampled at
   regular weights, and the driver picks the splitters from at most
   SAMPLE_GROUPS * GROUP_SAMPLES keys, whatever the input;
3. rows go to the segment between two splitters and are sorted there;
4. prefix counts over the segments give the first rank of each.  Segments
   wholly behind the last drawn rank are counted, not moved.

The sort key is score downwards, doc_id (null last), a hash of the row, then
the row's place in the written table, so equal scores and repeated rows are
split like others and only equal rows may swap ranks between runs.

Defined results: a null or empty text has no features, weight 0, and is not
drawn; a null doc_id draws its number as the empty id; repeated rows are
documents of their own; an empty table gives no rows; an empty target gives
every bucket its smoothed share.  Other columns are carried along; n_features,
weight, score and rank replace columns of these names.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from riskfold.llm.registry import register
from riskfold.llm.words import BIG_ID, documents, slices, spans_of, texts
from riskfold.session import cut_lineage

NGRAM = 1
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
LONG = 64

RUN_SAMPLES = 64
SAMPLE_GROUPS = 32
GROUP_SAMPLES = 256
SEGMENT_ROWS, LEAST_SEGMENTS, MOST_SEGMENTS = 4096, 64, 4096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[:0x30] = _GAP[0x3A:0x61] = _GAP[0x7B:0x80] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def _extend(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC states after the bytes data[start:end] of each: one pass per byte
    position over the spans that are that long; spans of over LONG bytes singly."""
    state, length = state.copy(), ends - starts
    for i in np.flatnonzero(length > LONG):
        state[i] = zlib.crc32(data[starts[i]:ends[i]], int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    length = np.where(length > LONG, 0, length)
    order = np.argsort(-length, kind="stable")
    alive = np.searchsorted(-length[order], -np.arange(1, int(length.max(initial=0)) + 1), side="right")
    for j, n in enumerate(alive):
        at = order[:n]
        state[at] = _CRC[(state[at] ^ data[starts[at] + j]) & np.uint32(0xFF)] ^ (state[at] >> np.uint32(8))
    return state


def features(rows: list[str], ngram: int = NGRAM, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bucket and row of every feature, and the words of every row."""
    raw = [t.encode() for t in rows]
    data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)]
    starts, ends = spans_of(_GAP[data])
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(t) + 1 for t in raw]))))
    row = np.repeat(np.arange(len(raw)), np.diff(first))
    state = _extend(np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32), data, starts, ends)
    found, places = [state], [row]
    for n in range(2, ngram + 1):
        inside = row[n - 1:] == row[:len(row) - n + 1]
        word = np.arange(n - 1, len(row))[inside]
        at = word - n + 1
        spaced = _CRC[(state[at] ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (state[at] >> np.uint32(8))
        state = state.copy()
        state[at] = _extend(spaced, data, starts[word], ends[word])
        found.append(state[at])
        places.append(row[at])
    return ((np.concatenate(found) ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64), np.concatenate(places), np.diff(first)


def bucket_counts(docs: DataFrame, text: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts per bucket.  A task adds its slices up, so the
    shuffle carries at most ``buckets`` rows a task and the driver gets
    ``buckets`` rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for part in slices(batches, "text"):
            total += np.bincount(features(texts(part), ngram, buckets)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in (docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket int, n long")
              .groupBy("bucket").agg(F.sum("n").alias("n")).collect()):
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) of every bucket."""
    b = len(source)
    s_all, t_all = float(source.sum() + b), float(target.sum() + b)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all)))
                     for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist())], dtype=np.int64)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 * ln(-ln u)), u from the first 32 bits of sha256(seed:id)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))


def score(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", doc_id: str = "doc_id",
          ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``, or all) plus n_words, n_features, weight,
    score and row_hash."""
    gains = gains_of(bucket_counts(docs, text, ngram, buckets), bucket_counts(target, target_text, ngram, buckets))
    made = ("n_words", "n_features", "weight", "score", "row_hash")
    carried = [c for c in (docs.columns if keep is None else keep) if c not in made]
    lean = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col(text).cast("string").alias("text"),
                       gumbel(F.col(doc_id), seed).alias("draw"), F.xxhash64(doc_id, text).alias("row_hash"))
    schema = StructType([*lean.drop("text").schema.fields, *[StructField(c, LongType()) for c in ("n_words", "n_features", "weight")]])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            bucket, row, words = features(texts(part), ngram, buckets)
            n = np.bincount(row, minlength=part.num_rows)
            # sums of whole numbers: exact in doubles below 2 ** 53
            total = np.bincount(row, weights=gains[bucket], minlength=part.num_rows).astype(np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("draw"), part.column("row_hash"),
                 pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight)],
                names=["row", "draw", "row_hash", "n_words", "n_features", "weight"])

    return lean.mapInArrow(weigh, schema).select(
        *[F.col("row")[c].alias(c) for c in carried], "n_words", "n_features", "weight",
        (F.col("weight") + F.col("draw")).alias("score"), "row_hash")


KEY = ("__score", "__id", "row_hash", "__run", "__at")
KEY_TYPE = "array<struct<__score: long, __id: long, row_hash: long, __run: int, __at: long>>"


def _regular(n: int, count: int) -> np.ndarray:
    """Up to ``count`` regular places in 0 .. n-1, the last one included."""
    count = min(n, count)
    return np.arange(1, count + 1) * n // count - 1


def ranked(scored: DataFrame, doc_id: str = "doc_id", min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` plus rank: 1, 2, 3 ... for the drawn rows, else null."""
    # written first, so that a row's place is the same whenever it is read
    table = cut_lineage(scored.drop("rank"))
    can = F.col("n_words") >= min_words
    nobody = F.lit(None).cast("long")
    total = table.where(can).count()
    want = total * percent // 100
    if want <= 0:
        return table.withColumn("rank", nobody)

    keyed = (table.withColumn("__run", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
             .withColumn("__score", -F.col("score")).withColumn("__id", F.coalesce(F.col(doc_id).cast("long"), F.lit(BIG_ID))))
    cuts = _splitters(_samples(keyed.where(can).select(*KEY)), min(MOST_SEGMENTS, max(LEAST_SEGMENTS, total // SEGMENT_ROWS)))
    keyed = keyed.withColumn("__segment", F.when(can, _segment(cuts)))
    sizes = dict(keyed.where(can).groupBy("__segment").count().collect())  # a row per segment
    first = [0]
    for s in range(len(cuts)):
        first.append(first[s] + sizes.get(s, 0))
    last = max(s for s, f in enumerate(first) if f < want)
    before = F.expr(f"array({', '.join(f'{f}L' for f in first[:last + 1])})")
    rank = F.get(before, F.col("__segment")) + F.row_number().over(Window.partitionBy("__segment").orderBy(*KEY))
    moved = F.coalesce(F.col("__segment") <= last, F.lit(False))
    near = keyed.where(moved).withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= want, F.col("rank")))
    far = keyed.where(~moved).withColumn("rank", nobody)
    return near.unionByName(far).select(*table.columns, "rank")


def _samples(keys: DataFrame) -> DataFrame:
    """Regular samples of all runs, merged and resampled in SAMPLE_GROUPS groups."""
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # the keys of one partition
        if held:
            run = pa.Table.from_batches(held)
            places = _regular(run.num_rows, RUN_SAMPLES)
            weight = np.diff(places, prepend=-1).astype(np.int64)
            yield from run.take(pa.array(places)).append_column("weight", pa.array(weight)).combine_chunks().to_batches()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(KEY), kind="stable")
        upto = group["weight"].cumsum().to_numpy()
        places = np.unique(np.searchsorted(upto, _regular(int(upto[-1]), GROUP_SAMPLES) + 1))
        return group.iloc[places].assign(weight=np.diff(upto[places], prepend=0))

    weighted = StructType([*keys.schema.fields, StructField("weight", LongType())])
    runs = keys.sortWithinPartitions(*KEY).mapInArrow(sample, weighted)
    return runs.groupBy(F.pmod(F.col("__run"), F.lit(SAMPLE_GROUPS))).applyInPandas(merge, weighted)


def _splitters(samples: DataFrame, segments: int) -> list[tuple]:
    """segments - 1 keys at regular weights."""
    rows = sorted(tuple(r) for r in samples.select(*KEY, "weight").collect())
    upto = np.cumsum([r[-1] for r in rows])
    places = np.unique(np.searchsorted(upto, np.arange(1, segments) * (upto[-1] / segments)))
    return [rows[p][:-1] for p in places]


def _segment(cuts: list[tuple]) -> Column:
    """Number of splitters below the row's key, by binary search in a constant array."""
    splitters = F.from_json(F.lit(json.dumps([dict(zip(KEY, c)) for c in cuts])), KEY_TYPE)
    key = F.struct(*KEY)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(splitters, at + step - 1) < key, at + step).otherwise(at))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, **options) -> DataFrame:
    """The drawn documents, all columns, with weight, score and rank."""
    return ranked(score(docs, target, **options), percent=percent).where("rank is not null").drop("n_words", "row_hash")


# The same in SQL: CRC-32 by its byte table, folded over the bytes of each distinct word.
_ORACLE = r"""
WITH RECURSIVE step(i, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
tab AS (SELECT list(CAST(c AS BIGINT) ORDER BY i) AS t FROM step WHERE k = 8),
w AS (SELECT kind, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
      FROM (SELECT 's' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark)),
d AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM w)),
b AS (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
                                   lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM d, tab),
f AS (SELECT w.kind, w.id, b.bucket FROM w JOIN b USING (word)),
n AS (SELECT bucket, count(*) FILTER (kind = 's') AS s, count(*) FILTER (kind = 't') AS t FROM f GROUP BY 1),
a AS (SELECT CAST(sum(s) + 10000 AS DOUBLE) AS s_all, CAST(sum(t) + 10000 AS DOUBLE) AS t_all FROM n),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * s_all / ((s + 1) * t_all))) AS BIGINT) AS gain FROM n, a),
m AS (SELECT id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM f JOIN g USING (bucket) WHERE kind = 's' GROUP BY 1),
o AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM documents LEFT JOIN m ON m.id = doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM o WHERE n_features >= 20)
SELECT o.doc_id, n_features, weight, score, CASE WHEN r.rank <= (SELECT count(*) FROM r) * 10 // 100 THEN r.rank END AS rank
FROM o LEFT JOIN r USING (doc_id)"""


@register("op13_importance_resample", _ORACLE)
def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return ranked(scored).select("doc_id", "n_features", "weight", "score", "rank")
