"""Benchmark decontamination by rare seeds and Smith-Waterman alignment (op 1).

Words are runs of ASCII letters, digits and non-ASCII characters of the
lower-cased text, so case, marks and line breaks don't hide a copy.

1. Document frequencies of all 3-word grams of the test items, over all
   documents (counted per task, then summed: a row per gram and task).
2. Seeds: an item's grams of low frequency, and always the rarer half of its
   own grams, so an item that leaked into a third of all documents keeps seeds.
3. Wherever seeds of an item meet in a document, the passage around them is
   aligned with the whole item: +2 for equal words, -1 for a changed, added
   or missing one (Smith-Waterman).  Score = best / (2 * words of the item);
   a copy has a score of 0.4, or an alignment of LONG_SCORE, so a long excerpt
   of a long item is found too.
   The passages of a slice are aligned side by side, a row of the matrix at a
   time.  Hits are (document, item, score, first and last word).

Scale: documents are read twice and never shuffled.  Test items are the small
side: they travel with the function in blocks of at most BLOCK_CHARS characters
(a larger benchmark takes more passes, none of its items is dropped).

Defined results: null and empty texts have no hits; an item needs
min(6, its words) aligned words, and one of fewer than three words is never
reported; rows of one doc_id are looked at each by itself; equal items are
reported each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from riskfold.llm.registry import register
from riskfold.llm.words import U64, Words, documents, ngrams, slices, texts
from riskfold.session import broadcast_if_small

GRAM = 3
LEAST_SCORE = 0.4
LEAST_WORDS = 6
LONG_SCORE = 80  # an alignment this long (40 equal words, more where some differ) counts however long the item is
KEY_BYTES = 32 << 20
COMMON_SHARE, COMMON_FLOOR = 1e-4, 10  # grams in fewer documents are seeds whatever their rank
BLOCK_CHARS = 16_000_000
CELLS = 1 << 21

_SEPARATOR = np.ones(256, dtype=bool)
_SEPARATOR[48:58] = _SEPARATOR[65:91] = _SEPARATOR[97:123] = _SEPARATOR[128:] = False


def _words(rows: list[str]) -> Words:
    return Words([t.lower() for t in rows], blank=_SEPARATOR)


def _row_grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that lie inside one row."""
    h = ngrams(words.hashes, GRAM)
    at = np.flatnonzero(words.row[:len(h)] == words.row[GRAM - 1:]) if len(h) else np.zeros(0, np.int64)
    return at, h[at] if len(at) else h[:0]


class Lookup:
    """Sorted gram hashes behind a bit table that turns most strangers away."""

    def __init__(self, keys: np.ndarray, bits: int = 22):
        self.keys, self.mask = keys, U64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, dtype=bool)
        self.table[(keys & self.mask).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of h are keys, their key numbers)"""
        some = np.flatnonzero(self.table[(h & self.mask).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
        ok = self.keys[at] == h[some]
        return some[ok], at[ok]


def document_frequencies(docs: DataFrame, keys: np.ndarray) -> np.ndarray:
    """For each gram, the number of documents that have it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, counts = Lookup(keys), np.zeros(len(keys), dtype=np.int64)
        for part in slices(batches, "text"):
            words = _words(texts(part))
            at, h = _row_grams(words)
            which, key = lookup.find(h)
            both = np.unique(words.row[at[which]].astype(np.int64) * len(keys) + key)
            counts += np.bincount(both % len(keys), minlength=len(keys))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some])], names=["key", "n"])

    out = np.zeros(len(keys), dtype=np.int64)
    for r in docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        out[r.key] = r.n
    return out


@dataclass
class Items:
    """Test items of a block: word hashes end to end, and the grams."""
    ids: list
    hashes: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, ids: list, rows: list[str]) -> Items:
        words = _words(rows)
        return cls(ids, words.hashes, words.first)

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """hash, item, offset in the item"""
        row = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        h = ngrams(self.hashes, GRAM)
        at = np.flatnonzero(row[:len(h)] == row[GRAM - 1:]) if len(h) else np.zeros(0, np.int64)
        return h[at] if len(at) else h[:0], row[at], at - self.first[row[at]]


def choose_seeds(item: np.ndarray, frequency: np.ndarray, documents_: int) -> np.ndarray:
    """Which grams seed: the rarer half of each item's, and all rare ones."""
    order = np.lexsort((frequency, item))
    place = np.empty(len(item), dtype=np.int64)
    sizes = np.bincount(item) if len(item) else np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    place[order] = np.arange(len(item)) - starts[item[order]]
    half = np.maximum(4, (sizes + 1) // 2)
    return (place < half[item]) | (frequency <= COMMON_FLOOR + COMMON_SHARE * documents_)


def align(queries: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman best scores of query i in passage i and where they end."""
    score, end = np.zeros(len(queries), dtype=np.int64), np.zeros(len(queries), dtype=np.int64)
    order = sorted(range(len(queries)), key=lambda i: (len(queries[i]), len(passages[i])))
    start = 0
    while start < len(order):
        stop, width = start, 0
        while stop < len(order) and (stop == start or (stop - start + 1) * max(width, len(passages[order[stop]])) <= CELLS):
            width = max(width, len(passages[order[stop]]))
            stop += 1
        use = order[start:stop]
        height = max(len(queries[i]) for i in use)
        # 0 and 1 stand for no word and never meet
        q, p = np.zeros((len(use), height), np.uint64), np.ones((len(use), width), np.uint64)
        for k, i in enumerate(use):
            q[k, :len(queries[i])] = queries[i]
            p[k, :len(passages[i])] = passages[i]
        slope = np.arange(width + 1, dtype=np.int32)
        row = np.zeros((len(use), width + 1), dtype=np.int32)
        best, place = np.zeros(len(use), dtype=np.int32), np.zeros(len(use), dtype=np.int64)
        for k in range(height):
            step = np.where(p == q[:, k:k + 1], np.int32(2), np.int32(-1))
            new = np.maximum(row - 1, 0)
            new[:, 1:] = np.maximum(new[:, 1:], row[:, :-1] + step)
            row = np.maximum.accumulate(new + slope, axis=1) - slope  # gaps along the passage cost 1 each
            top = row.argmax(axis=1)
            value = row[np.arange(len(use)), top]
            better = value > best
            best[better], place[better] = value[better], top[better]
        score[use], end[use] = best, place
        start = stop
    return score, end


def _passages(doc: np.ndarray, item: np.ndarray, at: np.ndarray, offset: np.ndarray, first: np.ndarray,
              lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Regions (row, item, from, to) around seeds: hits of an item whose
    passages would overlap are one region."""
    n = lengths[item]
    pad = 4 + n // 4
    begin = np.maximum(at - offset - pad, first[doc])
    end = np.minimum(at - offset + n + pad, first[doc + 1])
    order = np.lexsort((begin, item, doc))
    doc, item, begin, end = doc[order], item[order], begin[order], end[order]
    group = doc * (len(lengths) + 1) + item
    # running end of the regions of a (document, item) seen so far
    new = np.ones(len(doc), dtype=bool)
    if len(doc):
        shift = (np.cumsum(np.concatenate(([0], group[1:] != group[:-1])))) * (int(end.max()) + 1)
        reach = np.maximum.accumulate(end + shift)
        new[1:] = (begin + shift)[1:] > reach[:-1]
    starts = np.flatnonzero(new)
    return doc[starts], item[starts], begin[starts], np.maximum.reduceat(end, starts) if len(starts) else end


def find_copies(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word: each copy of a test item
    (of repeated copies in a document the best)."""
    lean = docs.select("doc_id", "text")
    count = lean.count()
    given = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    blocks = -(-(given.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS) or 1
    schema = docs.select("doc_id").schema.add("item_id", benchmark.schema["item_id"].dataType).add("score", "double") \
        .add("first_word", "long").add("last_word", "long")
    found = docs.sparkSession.createDataFrame([], schema)
    for b in range(blocks):
        rows = given.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        items = Items.of([r.item_id for r in rows], [r.text for r in rows])
        h, item, offset = items.grams()
        if len(h):
            found = found.unionByName(_find_block(lean, items, h, item, offset, count, least_score, schema))
    return found


def _find_block(lean, items, h, item, offset, count, least_score, schema) -> DataFrame:
    keys = np.unique(h)
    frequency = document_frequencies(lean, keys)
    seed = choose_seeds(item, frequency[np.searchsorted(keys, h)], count)
    order = np.argsort(h[seed], kind="stable")
    seed_hash, seed_item, seed_offset = h[seed][order], item[seed][order], offset[seed][order]
    id_type = to_arrow_type(schema["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, begin = np.unique(seed_hash, return_index=True)
        lookup, many = Lookup(own), np.diff(np.append(begin, len(seed_hash)))
        lengths = np.diff(items.first)
        for part in slices(batches, "text"):
            words = _words(texts(part))
            at, grams = _row_grams(words)
            which, key = lookup.find(grams)
            each = np.repeat(np.arange(len(which)), many[key])  # a gram can seed several items
            within = np.arange(len(each)) - np.repeat(np.cumsum(many[key]) - many[key], many[key])
            s = begin[key[each]] + within
            pos = at[which[each]]
            doc, it, a, b = _passages(words.row[pos], seed_item[s], pos, seed_offset[s], words.first, lengths)
            best, end = align([items.hashes[items.first[i]:items.first[i + 1]] for i in it.tolist()],
                              [words.hashes[x:y] for x, y in zip(a.tolist(), b.tolist())])
            n = lengths[it]
            ok = np.flatnonzero((best >= np.minimum(least_score * 2 * n, LONG_SCORE)) & (best >= 2 * np.minimum(LEAST_WORDS, n)))
            # best region of a (document, item)
            ok = ok[np.lexsort((a[ok], -best[ok], it[ok], doc[ok]))]
            first = np.ones(len(ok), dtype=bool)
            first[1:] = (doc[ok][1:] != doc[ok][:-1]) | (it[ok][1:] != it[ok][:-1])
            ok = ok[first]
            # the same alignment backwards tells where the copy begins
            back, length = align([items.hashes[items.first[i]:items.first[i + 1]][::-1] for i in it[ok].tolist()],
                                 [words.hashes[x:x + e][::-1] for x, e in zip(a[ok].tolist(), end[ok].tolist())])
            last = a[ok] + end[ok] - 1 - words.first[doc[ok]]
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").take(pa.array(doc[ok], pa.int64())), pa.array([items.ids[i] for i in it[ok].tolist()], id_type),
                pa.array(best[ok] / (2 * n[ok])), pa.array(last - length + 1, pa.int64()), pa.array(last, pa.int64())],
                names=["doc_id", "item_id", "score", "first_word", "last_word"])

    return lean.mapInArrow(run, schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a copy of a test item (rows are told
    apart by a hash of doc_id and text, so a shared or null doc_id does no harm)."""
    marked = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    hits = find_copies(marked.select(F.col("__key").alias("doc_id"), "text"), benchmark)
    # a key a contaminated row: broadcast while they are few, so the texts stay where they lie
    dirty = broadcast_if_small(hits.select(F.col("doc_id").alias("__key")).distinct(), KEY_BYTES)
    return marked.join(dirty, "__key", "left_anti").select(*docs.columns)


@register("op1_decontaminate")
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
