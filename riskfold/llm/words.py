"""Shared pieces: table scan, memory-bounded slices of Arrow batches, words.

A *word* is a maximal run of characters other than the six ASCII blanks
(space, tab, line feed, vertical tab, form feed, carriage return).  On UTF-8
bytes this is exactly what ``bytes.split()`` cuts, so words never need a regex.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
# Text bytes handled at once inside a task: bounds the numpy arrays of a slice.
SLICE_BYTES = 1 << 20
GIVE_BACK_BYTES = 32 << 20
BIG_ID = (1 << 63) - 1

U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_or_last(doc_id: Column | str) -> Column:
    """doc_id as long; a null id counts as larger than every other."""
    return F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(BIG_ID)).cast("long")


def id_or_null(doc_id: str) -> Column:
    return F.when(F.col(doc_id) != BIG_ID, F.col(doc_id))


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


# What an operator keeps from task to task in a Python worker, by operator.
_worker_caches: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """The owner's cache in this worker process; those of other operators are
    dropped, so a worker that serves several in turn holds one at a time."""
    for other in [o for o in _worker_caches if o != owner]:
        _worker_caches.pop(other).clear()
    return _worker_caches.setdefault(owner, {})


@contextlib.contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs run inside; the
    session's setting is put back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before) if int(before) > 0 else rows)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _give_back() -> None:
    """Return freed memory to the system: Python workers are reused and would
    keep the largest task's heap for the life of the application."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES,
           owner: str = "") -> Iterator[pa.RecordBatch]:
    """Consecutive slices whose ``column`` holds about ``limit`` bytes; a
    longer text is a slice of its own.  No row is dropped."""
    worker_cache(owner)
    since = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False),
                         dtype=np.int64)
        start, since = 0, since + int(ends[-1])
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end
        del batch
        if since >= GIVE_BACK_BYTES:
            since = 0
            _give_back()
    _give_back()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix constants) over an uint64 array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _odd_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U64(0xD1342543DE82EF95))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def spans_of(blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs where ``blank`` is false."""
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: polynomial prefix sums modulo 2**64, so the
    cost is a few passes over the bytes however many spans there are."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    n = len(data) + 1
    if not _powers or len(_powers[0]) < n:
        _powers[:] = _odd_powers(max(n, SLICE_BYTES + SLICE_BYTES // 4))
    up, down = _powers
    sums = np.empty(n, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up[:n - 1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * U64(0xA24BAED4963EE407)))


class Words:
    """All words of a slice: 64-bit hash of each, and the first word of each row."""

    def __init__(self, rows: list[str] | list[bytes], blank: np.ndarray = _BLANK):
        raw = [t.encode() if isinstance(t, str) else t for t in rows]
        self.buffer = b"\n".join(raw) + b"\n"
        data = np.frombuffer(self.buffer, dtype=np.uint8)
        self.starts, self.ends = spans_of(blank[data])
        self.hashes = span_hashes(data, self.starts, self.ends)
        row_start = np.concatenate(([0], np.cumsum([len(t) + 1 for t in raw])))
        #: words of row r are first[r]:first[r + 1]
        self.first = np.searchsorted(self.starts, row_start)
        self.row = np.repeat(np.arange(len(raw)), np.diff(self.first))


def ngrams(hashes: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hash of the n words from each position on (positions 0..len-n)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    k = mix(np.arange(seed * 1000 + 1, seed * 1000 + n + 1, dtype=np.uint64)) | U64(1)
    out = hashes[:m] * k[0]
    for i in range(1, n):
        out += hashes[i:i + m] * k[i]
    return mix(out)
