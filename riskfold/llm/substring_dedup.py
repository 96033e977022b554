"""Substring dedup by difference-cover anchors (op 2).

A window is ``WINDOW`` consecutive words; every word covered by a window whose
words also start in a document with a smaller doc_id goes.

1. Anchors: runs of PERIOD words that begin at a position whose rest modulo
   PERIOD is in COVER.  COVER is a difference cover: for any two positions i, j
   some d < PERIOD puts i + d and j + d both into it.  So two equal windows
   share an anchor at the same offset (d + PERIOD <= 2 * PERIOD - 1 = WINDOW),
   though only 3 of 7 positions are hashed.
2. An anchor hash found in two documents is shared.  Frequent anchors are told
   from a bounded sample of documents; they are known to be shared and need no
   comparison.  All others are compared by hash.
3. Extension: only windows around a document's shared anchors are hashed (96
   bits) and compared with the least doc_id that has them.  Windows on frequent
   anchors are compared in two levels (per salt, then the least of the salts).
4. The windows found go back to their documents, which drop the words.

Scale: no pairs are made; a passage in a third of all documents costs a row
for each document, spread by salt.  Texts are shuffled by doc_id once and that
exchange is used by both later passes.  Rows that share an id, or have none,
are told apart by a text hash (k; 0 where the id is a row's own), so the lists
of anchors and windows are bounded by one text.  The sample (SAMPLE_DOCS) only decides how rows are spread: results
are the same whatever it holds.

Defined results: words are unchanged and kept ones joined by one space; null
text has none; a null doc_id counts as larger than every other; rows with the
same doc_id never remove each other's words; an empty table gives no rows;
other columns of ``docs`` are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from riskfold.llm.registry import register
from riskfold.llm.words import SLICE_BYTES, Words, documents, id_or_last, id_or_null, ngrams, slices, texts
from riskfold.session import broadcast_if_small, cut_lineage

PERIOD, COVER = 7, (0, 1, 3)
WINDOW = 2 * PERIOD - 1
SAMPLE_DOCS = 20_000
FREQUENT = 50
SALTS = 64
# Anchors are compared by 48 bits: a chance match only adds windows that the
# exact step then turns down (below 3 % more at 10**13 anchors).
ANCHOR_SHIFT = np.uint64(16)


U32 = np.uint64(32)


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in the slice) and hashes of the anchors of every row that has a window."""
    n = len(words.hashes)
    place = np.arange(n) - words.first[words.row]
    length = np.diff(words.first)[words.row]
    at = np.flatnonzero(np.isin(place % PERIOD, COVER) & (place + PERIOD <= length) & (length >= WINDOW))
    return at, ngrams(words.hashes, PERIOD)[at] >> ANCHOR_SHIFT if len(at) else np.zeros(0, np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _compact(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` as compressed bytes: the text is the bulk of what is shuffled."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for part in slices(batches, "text"):
            packed = pa.array([packer.compress(t.encode()) for t in texts(part)], pa.binary())
            yield pa.RecordBatch.from_arrays([packed if c == "text" else part.column(c) for c in names], names=names)

    schema = docs.schema
    schema["text"].dataType = BinaryType()
    return docs.mapInArrow(run, schema)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    unpacker = zstandard.ZstdDecompressor()
    for part in slices(batches, "text", SLICE_BYTES // 3):
        yield part, [unpacker.decompress(t) for t in part.column("text").to_pylist()]


def _member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.isin(x, of) if len(of) else np.zeros(len(x), dtype=bool)


def _list_values(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` plus k: a text hash where several rows have the same d, else 0."""
    repeated = cut_lineage(docs.groupBy("d").count().where("count > 1").select("d"))
    if repeated.isEmpty():
        return docs.withColumn("k", F.lit(0).cast("long"))
    marked = docs.join(broadcast_if_small(repeated.withColumn("again", F.lit(True))), "d", "left")
    return marked.withColumn("k", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop("again")


def _shared_anchors(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(d, k, anchors): hashes of each document's anchors that other documents
    have; frequent ones are known to be shared and never travel."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(texts(part))
            at, h = _anchors(words)
            rare = ~_member(h, frequent)
            h, row = h[rare], words.row[at[rare]]
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            d, k = (part.column(c).to_numpy(zero_copy_only=False)[row[new]] for c in ("d", "k"))
            yield pa.RecordBatch.from_arrays([_signed(h[new]), pa.array(d), pa.array(k)], names=["h", "d", "k"])

    same = Window.partitionBy("h")
    return (docs.select("d", "k", "text").mapInArrow(run, "h long, d long, k long")
            .withColumn("shared", F.min("d").over(same) < F.max("d").over(same))
            .where("shared").groupBy("d", "k").agg(F.collect_set("h").alias("anchors")))


def _frequent_anchors(docs: DataFrame, sample_docs: int, frequent: int) -> np.ndarray:
    """Anchors in at least ``frequent`` documents of a sample of about
    ``sample_docs``: at most sample anchors / frequent hashes come back."""
    every = max(1, docs.count() // sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(texts(part))
            at, h = _anchors(words)
            pairs = np.unique(np.rec.fromarrays([words.row[at], h])) if len(at) else None
            yield pa.RecordBatch.from_arrays([_signed(np.ascontiguousarray(pairs.f1) if pairs is not None else h)], names=["h"])

    sample = docs.where(F.pmod(F.xxhash64("d", F.lit(2)), F.lit(every)) == 0)
    rows = (sample.select("text").mapInArrow(run, "h long").groupBy("h").count()
            .where(F.col("count") >= frequent).select("h").collect())
    return np.sort(np.array([r.h for r in rows], dtype=np.int64).view(np.uint64))


def _candidate_windows(docs: DataFrame, anchors: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(w, x, d, k): 96-bit hashes (w and the upper half of x) of the windows
    around shared anchors; the lower half of x is the salt, 0 for none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _unpacked(batches):
            words = Words(rows)
            at, h = _anchors(words)
            n = len(words.hashes)
            near = np.zeros(n + 1, dtype=np.int64)
            use = _member(h, _list_values(part.column("anchors"))) | _member(h, frequent)
            np.add.at(near, np.maximum(at - (WINDOW - PERIOD), words.first[words.row[at]])[use], 1)
            np.add.at(near, at[use] + 1, -1)
            left = words.first[1:][words.row] - np.arange(n)
            start = np.flatnonzero((np.cumsum(near)[:n] > 0) & (left >= WINDOW))
            # by content alone, so a window is salted in all its documents or in none
            hot = np.concatenate(([0], np.cumsum(_member(ngrams(words.hashes, PERIOD) >> ANCHOR_SHIFT, frequent))))
            w, x = ngrams(words.hashes, WINDOW, 2)[start], ngrams(words.hashes, WINDOW, 3)[start]
            row = words.row[start]
            order = np.lexsort((w, row))
            w, x, row, start = w[order], x[order], row[order], start[order]
            new = np.ones(len(w), dtype=bool)
            new[1:] = (w[1:] != w[:-1]) | (x[1:] != x[:-1]) | (row[1:] != row[:-1])
            w, x, row, start = w[new], x[new], row[new], start[new]
            d, k = (part.column(c).to_numpy(zero_copy_only=False)[row] for c in ("d", "k"))
            salt = np.where(hot[start + PERIOD] > hot[start], 1 + (d ^ k) % SALTS, 0).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([_signed(w), _signed(x >> U32 << U32 | salt), pa.array(d), pa.array(k)], names=["w", "x", "d", "k"])

    return docs.join(anchors, ["d", "k"], "left").select("d", "k", "text", "anchors").mapInArrow(run, "w long, x long, d long, k long")


def _repeated_windows(windows: DataFrame) -> DataFrame:
    """(d, k, windows): first halves of the hashes of d's windows that a smaller d has too."""
    least = windows.withColumn("least", F.min("d").over(Window.partitionBy("w", "x")))
    later = least.where("d > least").select("w", "d", "k")
    # one expression, so it stays above the window and both branches use one exchange
    firsts = least.where(F.when(F.col("d") == F.col("least"), F.col("x").bitwiseAND(F.lit(255))).otherwise(0) > 0).select("w", F.shiftright("x", 32).alias("y"), "d", "k")
    again = firsts.withColumn("least", F.min("d").over(Window.partitionBy("w", "y"))).where("d > least").select("w", "d", "k")
    return later.unionByName(again).groupBy("d", "k").agg(F.collect_set("w").alias("windows"))


def remove_repeats(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, frequent: int = FREQUENT) -> DataFrame:
    """``docs`` plus n_words, n_removed, kept_text (columns of these names are replaced)."""
    # other columns travel under numbers, so their names cannot clash with ours
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_words", "n_removed", "kept_text")]
    columns = ["d", "k", "text", *(f"c{i}" for i in range(len(rest)))]
    given = docs.select("doc_id", "text", *rest).toDF("doc_id", *columns[2:]).withColumn("d", id_or_last("doc_id"))
    given = _with_row_key(given).select(*columns)
    lean = given.select("d", "k", "text")
    hot = _frequent_anchors(lean, sample_docs, frequent)
    anchors = _shared_anchors(lean, hot)
    packed = _compact(given)
    repeats = _repeated_windows(_candidate_windows(packed, anchors, hot))
    joined = packed.join(repeats, ["d", "k"], "left")
    schema = given.select(*columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _unpacked(batches):
            words = Words(rows)
            w = ngrams(words.hashes, WINDOW, 2)
            lists = part.column("windows")
            total, removed, kept = [], [], []
            for r, t in enumerate(rows):
                a, b = words.first[r], words.first[r + 1]
                own = t.split()
                gone = 0
                if lists[r].is_valid and b - a >= WINDOW:
                    hit = np.flatnonzero(np.isin(w[a:b - WINDOW + 1], lists[r].values.to_numpy(zero_copy_only=False).view(np.uint64)))
                    edge = np.zeros(b - a + 1, dtype=np.int64)
                    np.add.at(edge, hit, 1)
                    np.add.at(edge, hit + WINDOW, -1)
                    stay = np.cumsum(edge)[:-1] == 0
                    gone = int(len(stay) - stay.sum())
                    kept.append(b" ".join([own[i] for i in np.flatnonzero(stay).tolist()]))
                else:
                    kept.append(b" ".join(own))
                total.append(b - a)
                removed.append(gone)
            arrays = [pa.array([t.decode() for t in rows], pa.string()) if c == "text" else part.column(c) for c in columns] + [
                pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=columns + ["n_words", "n_removed", "kept_text"])

    out = schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    found = joined.select(*columns, "windows").mapInArrow(run, out)
    return found.select(id_or_null("d").alias("doc_id"), "text", *(F.col(c).alias(r) for c, r in zip(columns[3:], rest)),
                        "n_words", "n_removed", "kept_text")


_ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM t, unnest(range(1, greatest(len(ws) - 11, 1))) u(i)),
m AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT w.doc_id, w.i + k AS p FROM w JOIN m USING (g), unnest(range(0, 13)) v(k) WHERE w.doc_id > m.least),
x AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE
    list_transform(list_filter(range(1, len(ws) + 1), lambda j: NOT list_contains(ps, j)), lambda j: ws[j]) END, ' ')) AS kept_sha256
FROM t LEFT JOIN x USING (doc_id)
"""


@register("op2_substring_dedup", _ORACLE)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
