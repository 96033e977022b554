"""Periodic run detection (op 11).

A run is a stretch of consecutive words with smallest period q that no
neighbouring word extends, here of at least ``min_exponent`` periods and
``min_words`` words.  All runs of a text are found by longest common
extensions on suffix trees:

1. Ukkonen's algorithm builds the suffix trees of the word sequence and of its
   reversal.  An Euler tour in symbol order gives each leaf its rank and the
   word depth of the lowest node between neighbouring leaves; range minima over
   a sparse table answer every LCA, and so every common extension, in constant
   time (as array operations over all queries at once).
2. The root of a run that is a Lyndon word is the longest Lyndon word at its
   place, for the word order or for the reversed one.  These are cut off by the
   next smaller (next greater) suffix rank, which makes two candidates a word.
3. A candidate of period q is extended to the right by the forward tree and to
   the left by the tree of the reversal; the stretch is a run if it is long
   enough, and the same run found at several of its roots is kept once.

Trees are built where a run can lie.  The words of a run of at least three
periods and 24 words are all covered by 16-word windows that occur again within
the run, so only stretches of words whose window hash occurs again in the text,
at a distance of at most a third of the stretch, are looked at (``stretches``);
words are compared there by their bytes.  A hash that agrees by chance only
adds a stretch.  A run cannot reach over the end of its stretch.

Scale: a text is the unit of work and nothing is shuffled.  Memory grows with
the longest stretch of one text (some 500 bytes a word).

Defined results: a null or empty text, or one without words, has no runs and
an empty collapsed text; repeated rows and null doc_ids are rows of their own;
an empty table gives no rows; runs are ordered by start, then period; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.llm.registry import register
from riskfold.llm.words import Words, documents, ngrams, slices, texts

MIN_WORDS = 24
MIN_EXPONENT = 3

RUNS_SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class SuffixTree:
    """Suffix tree of whole numbers below ``alphabet`` by Ukkonen's algorithm,
    with an end mark that is smaller than all of them.

    ``rank[i]`` is the place of suffix i in sorted order; ``extension(i, j)``
    the common prefix length of suffixes i and j."""

    def __init__(self, symbols: np.ndarray):
        s = [int(x) + 1 for x in symbols] + [0]
        self.n = len(s)
        self._build(s)
        self._tour(s)

    def _build(self, s: list[int]) -> None:
        n, width = len(s), max(s) + 1
        begin, end, link = [0], [0], [0]   # edge into each node: s[begin:end]; node 0 is the root
        child: dict[int, int] = {}         # node * width + first symbol -> node
        node = edge = length = waiting = 0
        for i, c in enumerate(s):
            waiting += 1
            last = 0
            while waiting:
                if not length:
                    edge = i
                key = node * width + s[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(begin)
                    begin.append(i)
                    end.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                    last = node
                else:
                    size = (end[below] if end[below] < i + 1 else i + 1) - begin[below]
                    if length >= size:
                        edge += size
                        length -= size
                        node = below
                        continue
                    if s[begin[below] + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    split = len(begin)
                    start = begin[below]
                    begin += [start, i]
                    end += [start + length, n]
                    link += [0, 0]
                    child[key] = split
                    child[split * width + c] = split + 1
                    begin[below] = start + length
                    child[split * width + s[start + length]] = below
                    if last:
                        link[last] = split
                    last = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self._begin, self._end, self._child, self._width = begin, end, child, width

    def _tour(self, s: list[int]) -> None:
        """Euler tour with children in symbol order: the sorted suffixes and the
        depth of the highest node between neighbouring ones."""
        keys = np.fromiter(self._child.keys(), dtype=np.int64, count=len(self._child))
        below = np.fromiter(self._child.values(), dtype=np.int64, count=len(keys))
        order = np.argsort(keys)[::-1]  # greatest symbol first: a stack returns the least
        keys, below = keys[order], below[order]
        above = keys // self._width
        nodes = len(self._begin)
        first, upto = np.searchsorted(-above, -np.arange(nodes)), np.searchsorted(-above, -np.arange(nodes), side="right")
        first, upto, below = first.tolist(), upto.tolist(), below.tolist()
        begin, end, n = self._begin, self._end, self.n
        depth = [0] * nodes
        suffixes, between = [], []
        lowest = n
        stack = below[first[0]:upto[0]]
        up = [0] * nodes
        while stack:
            node = stack.pop()
            parent = up[node]
            if depth[parent] < lowest:
                lowest = depth[parent]
            d = depth[node] = depth[parent] + end[node] - begin[node]
            if first[node] == upto[node]:
                suffixes.append(n - d)
                between.append(lowest)
                lowest = n
            else:
                inside = below[first[node]:upto[node]]
                for x in inside:
                    up[x] = node
                stack += inside
        del self._begin, self._end, self._child
        self.rank = np.empty(n, dtype=np.int64)
        self.rank[suffixes] = np.arange(n)
        table = [np.array(between, dtype=np.int32)]
        while len(table[-1]) > 1 << (len(table) - 1):
            half, gap = table[-1], 1 << (len(table) - 1)
            table.append(np.minimum(half[:-gap], half[gap:]))
        self._minima = table

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1  # minima of between[lo:hi]
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), dtype=np.int64)
        for k in np.unique(level):
            at = level == k
            row = self._minima[k]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(k))])
        return out


def _next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one of smaller rank (the end if there is none)."""
    out = [len(rank)] * len(rank)
    stack: list[int] = []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs_of(symbols: np.ndarray, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """All runs of a sequence as rows (start, length, period), ordered."""
    n = len(symbols)
    none = np.zeros((0, 3), dtype=np.int64)
    if n < max(min_words, min_exponent):
        return none
    ahead, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    rank = ahead.rank.tolist()  # the end mark takes part: it is the least suffix
    i = np.tile(np.arange(n), 2)
    j = np.array(_next_smaller(rank)[:n] + _next_smaller([-r for r in rank])[:n])
    able = (j < n) & ((j - i) * min_exponent <= n)
    i, j = i[able], j[able]
    right = ahead.extension(i, j)
    left = np.zeros(len(i), dtype=np.int64)
    inner = i > 0
    left[inner] = back.extension(n - i[inner], n - j[inner])
    period = j - i
    start, length = i - left, period + left + right
    good = (length >= min_words) & (length >= min_exponent * period)
    if not good.any():
        return none
    return np.unique(np.stack([start[good], length[good], period[good]], axis=1)[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def _windows(min_words: int, min_exponent: int) -> int:
    """Longest window of which every run's first period has a start and that
    occurs again one period on: length - period words at least."""
    return min(max(min_words, min_exponent * q) - q for q in range(1, min_words + 1))


def stretches(hashes: np.ndarray, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int]]:
    """(start, end) of the maximal stretches of words covered by windows that
    occur again near by; every run lies inside one."""
    w = _windows(min_words, min_exponent)
    n = len(hashes)
    if n < min_words:
        return []
    h = ngrams(hashes, w)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    gap = np.full(len(h), n, dtype=np.int64)
    step = np.where(same, np.diff(order), n)
    gap[order[:-1]] = step
    gap[order[1:]] = np.minimum(gap[order[1:]], step)
    marked = gap < n
    while True:
        cover = np.zeros(n + 1, dtype=np.int64)
        at = np.flatnonzero(marked)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + w, -1)
        covered = np.cumsum(cover[:-1]) > 0
        edge = np.diff(np.concatenate(([False], covered, [False])).astype(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        longest = np.zeros(n, dtype=np.int64)
        for a, b in zip(first, last):
            longest[a:b] = b - a if b - a >= min_words else 0
        kept = marked & (gap * min_exponent <= longest[:len(h)])
        if kept.sum() == marked.sum():
            return [(int(a), int(b)) for a, b in zip(first, last)]
        marked = kept


def _find(words: list[bytes], hashes: np.ndarray, min_words: int, min_exponent: int) -> list[tuple[int, int, int]]:
    found = []
    for a, b in stretches(hashes, min_words, min_exponent):
        number: dict[bytes, int] = {}
        symbols = np.array([number.setdefault(x, len(number)) for x in words[a:b]])
        found += [(int(s) + a, int(n), int(q)) for s, n, q in runs_of(symbols, min_words, min_exponent)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def _collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return b" ".join(words[i] for i in kept)


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                  min_exponent: int = MIN_EXPONENT, reorder: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs and the text without repeated periods, its words
    joined by one space.  ``reorder(doc_id, n)`` may name the words to read
    instead of 0 .. n-1."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            raw = [t.encode() for t in texts(part)]
            seen = Words(raw)
            keys = part.column("doc_id").to_pylist()
            counts, runs, collapsed = [], [], []
            for r, key in enumerate(keys):
                words = raw[r].split()
                hashes = seen.hashes[seen.first[r]:seen.first[r + 1]]
                at = reorder(key, len(words)) if reorder else None
                if at is not None:
                    words, hashes = [words[i] for i in at], hashes[at]
                found = _find(words, hashes, min_words, min_exponent)
                counts.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), f)) for f in found])
                collapsed.append(_collapse(words, found).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(collapsed, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(scan, RUNS_SCHEMA)


def tail_repeats(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's word order: for a tenth of the ids, by crc32 of the id, the
    words from some place on repeat the first few of them."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


@register("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(documents(spark, sf_dir), reorder=tail_repeats)

    def further(best, run):
        """The run of greater exponent; earlier start, then smaller period on ties (runs come in that order)."""
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), further)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"),
                                                   F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")
