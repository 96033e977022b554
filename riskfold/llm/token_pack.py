"""Token ids in fixed-width bit packing (op 6).

File format: a Parquet folder, one row per block.  A block holds whole
documents in ascending doc_id order and packs their ids at ``width`` =
bits of the largest vocabulary id, 64 ids to ``width`` little-endian 64-bit
words, so pack and unpack are numpy column operations and id i of a block
starts at bit i * width.  ``shard`` / ``block`` / ``first`` (ids of the shard
before the block) are the block offsets, ``doc_ids`` / ``n_tokens`` the
documents inside.  Spark's committer writes the folder: a lost executor's
blocks are written again, and any store that Spark writes to will do.

Defined results: a null text is the empty text (its only id is the end id);
null doc_ids come last; repeated rows are documents of their own, ordered by
text; an empty table gives an empty folder and no rows; extra columns are
ignored.  Long texts are encoded whole.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskfold.llm.registry import register
from riskfold.llm.words import documents, rows_per_batch, slices, texts, worker_cache
from riskfold.session import checkpoint_dir

BLOCK_TOKENS = 1 << 16
BATCH_ROWS = 1000
CACHE_ENTRIES = 600_000  # of each generation; some 200 bytes an entry
OWNER = "token_pack"
_ID = attrgetter("id")

BLOCK_SCHEMA = ("shard int, block int, first long, width int, tokens long, "
                "doc_ids array<long>, n_tokens array<int>, payload binary")
RESULT_SCHEMA = "doc_id long, shard int, at long, n_tokens long, ids_crc32 long"


def width_of(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


WHOLE = {8: "<u1", 16: "<u2", 32: "<u4", 64: "<u8"}


def pack(ids: np.ndarray, width: int) -> bytes:
    n = -(-len(ids) // 64) * 64
    if width in WHOLE:  # whole bytes: the same layout without shifts
        out = np.zeros(n, dtype=WHOLE[width])
        out[:len(ids)] = ids
        return out.tobytes()
    lanes = np.zeros(n, dtype=np.uint64)
    lanes[:len(ids)] = ids
    lanes = lanes.reshape(-1, 64)
    out = np.zeros((len(lanes), width), dtype="<u8")
    for k in range(64):
        word, shift = divmod(k * width, 64)
        out[:, word] |= lanes[:, k] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= lanes[:, k] >> np.uint64(64 - shift)
    return out.tobytes()


def unpack(payload: bytes, width: int, start: int, count: int) -> np.ndarray:
    """Ids start .. start + count - 1; touches only their 64-id groups."""
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    if width in WHOLE:
        return np.frombuffer(payload, dtype=WHOLE[width], offset=start * width // 8, count=count)
    a, b = start // 64, -(-(start + count) // 64)
    words = np.frombuffer(payload, dtype="<u8", offset=a * width * 8, count=(b - a) * width).reshape(-1, width)
    out = np.empty((b - a, 64), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, k] = x & mask
    return out.reshape(-1)[start - a * 64:start - a * 64 + count]


class _Pieces(dict):
    """Piece -> ids, in two generations."""

    def __init__(self, encoder: Encoder, entries: int):
        super().__init__()
        self.encoder, self.entries, self.old = encoder, entries, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.encoder.piece_ids(key)
        self[key] = ids
        return ids

    def age(self) -> None:
        if len(self) > self.entries:
            self.old = self.copy()
            self.clear()


class Encoder:
    """The tokenizers library with a cache over blank-delimited pieces.

    A byte-level BPE cuts text before a single space that stands between
    non-blanks and around a single line end, so the ids of a text are the ids
    of its pieces in a row.  Texts with two blanks in a row are cut by
    ``PIECES``, which leaves a run of blanks as the pre-tokenizer does; texts
    with other blanks or special tokens are encoded whole, as are all texts
    of tokenizers with another pre-tokenizer.

    Piece keys: ``\\0x`` is x without a space before it, ``x`` is x after a
    space.  The cache has two generations of at most CACHE_ENTRIES pieces;
    pieces in use move to the young one, the old one is dropped whole.
    """

    PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+")
    #: two blanks in a row, or a blank at either end (asked of "\n" + text + "\n")
    RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\r")
    #: blanks and near-blanks on which regex engines may differ, and the mark of piece keys
    ODD = tuple(sorted({chr(c) for c in range(0x10000) if chr(c).isspace()} - set(" \n\t\r") | set("\0᠎​﻿")))
    LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
    LATIN = re.compile(f"[{LETTERS}]+")
    MARKS = frozenset(".,;:!?|")

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.code = "H" if self.dtype == "<u2" else "I"
        self.by_piece = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                         and (spec.get("model") or {}).get("type") == "BPE" and not pre.get("add_prefix_space") and spec.get("normalizer") is None)
        if self.by_piece:
            self.model, self.pre_cut = self.tokenizer.model.tokenize, self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.space = self.pre_cut(" a")[0][0][:-1]
            letters = re.findall(f"[{self.LETTERS}]", "".join(map(chr, range(0x250))))
            self.bytes_as_text = str.maketrans({c: self.pre_cut(c)[0][0] for c in letters})
        self.cache = _Pieces(self, cache_entries)

    @classmethod
    def of(cls, path: str, cache_entries: int = CACHE_ENTRIES) -> Encoder:
        """One per worker process, so later tasks find a warm cache."""
        encoders = worker_cache(OWNER)
        if path not in encoders:
            encoders[path] = cls(path)
        encoders[path].cache.entries = cache_entries
        return encoders[path]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def piece_ids(self, key: str) -> bytes:
        """Ids of an unseen piece.  A plain word is one pre-token, so the BPE
        model takes it directly; a mark behind it is a pre-token of its own;
        other pieces go through the pre-tokenizer first."""
        glued = key[:1] == "\0"
        piece = key[1:] if glued else key
        if piece[-1:] in self.MARKS and piece[:-1].isalpha():
            return self.cache[key[:-1]] + self.cache["\0" + piece[-1]]
        if piece.isalpha() and (piece.isascii() or self.LATIN.fullmatch(piece)):
            text = piece if piece.isascii() else piece.translate(self.bytes_as_text)
            return array(self.code, map(_ID, self.model(text if glued else self.space + text))).tobytes()
        cut = self.pre_cut(piece if glued else " " + piece) if piece or not glued else []
        return array(self.code, [t.id for text, _ in cut for t in self.model(text)]).tobytes()

    def _cut(self, text: str) -> list[str]:
        ended = f"\n{text}\n"
        if any(r in ended for r in self.RUNS):
            return [p[1:] if p[0] == " " and len(p) > 1 and not p.isspace() else "\0" + p for p in self.PIECES.findall(text)]
        return ("\0" + text.replace("\n", " \0\n \0")).split(" ")

    def encode_all(self, rows: list[str]) -> list[bytes]:
        """Little-endian ids of each row, as bytes of ``dtype``."""
        out: list[bytes | None] = [None] * len(rows)
        cut: dict[int, list[str]] = {}
        odd = self.ODD + tuple(self.special)
        odd_ascii = tuple(x for x in odd if x.isascii())
        for i, t in enumerate(rows):
            if self.by_piece and not any(x in t for x in (odd_ascii if t.isascii() else odd)):
                cut[i] = self._cut(t)
            else:
                out[i] = self._ids(t).tobytes()
        self.cache.age()
        for i, pieces in cut.items():
            out[i] = b"".join(map(self.cache.__getitem__, pieces))
        return out


def write_blocks(docs: DataFrame, path: str, tokenizer_path: str, vocab_size: int, end_id: int = 0,
                 doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS,
                 cache_entries: int = CACHE_ENTRIES) -> None:
    """Encode every text, append ``end_id``, write blocks in doc_id order."""
    width = width_of(vocab_size)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path, cache_entries)
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        size = np.dtype(encoder.dtype).itemsize
        ids: list = []
        rows: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(rows), dtype=encoder.dtype)
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()),
                pa.array([width], pa.int32()), pa.array([len(tokens)], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([[len(r) // size for r in rows]], pa.list_(pa.int32())),
                pa.array([pack(tokens, width)], pa.binary())],
                names=["shard", "block", "first", "width", "tokens", "doc_ids", "n_tokens", "payload"])

        for part in slices(batches, "text", owner=OWNER):
            for i, r in zip(part.column("doc_id").to_pylist(), encoder.encode_all(texts(part))):
                ids.append(i)
                rows.append(r + end)
                held += len(r) // size + 1
                if held >= block_tokens:
                    yield flush()
                    block, first, held = block + 1, first + held, 0
                    ids, rows = [], []
        if rows:
            yield flush()

    key = F.col("doc_id").asc_nulls_last()
    tie = F.xxhash64("text")
    # texts cross to Python in small batches: the piece cache needs the memory
    with rows_per_batch(docs.sparkSession, BATCH_ROWS):
        (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
         .repartitionByRange(key, tie).sortWithinPartitions(key, tie, "text")
         .mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(path))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files alone: doc_id, start, n_tokens, ids_crc32."""
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                counts = np.array(row["n_tokens"].as_py(), dtype=np.int64)
                ids = unpack(row["payload"].as_py(), row["width"].as_py(), 0, int(counts.sum())).astype("<u4")
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[e - c:e]) for c, e in zip(counts, ends)]
                yield pa.RecordBatch.from_arrays([
                    row["doc_ids"].values, pa.array([row["shard"].as_py()] * len(counts), pa.int32()),
                    pa.array(row["first"].as_py() + ends - counts, pa.int64()), pa.array(counts, pa.int64()),
                    pa.array(crc, pa.int64())], names=["doc_id", "shard", "at", "n_tokens", "ids_crc32"])

    files = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # a row per shard: as many as files, whatever the documents
    before = (files.groupBy("shard").agg(F.sum("tokens").alias("tokens"))
              .withColumn("before", F.coalesce(F.sum("tokens").over(
                  Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .select("shard", "before"))
    found = files.select("shard", "first", "width", "doc_ids", "n_tokens", "payload").mapInArrow(digests, RESULT_SCHEMA)
    return found.join(before, "shard").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokenize(docs: DataFrame, tokenizer_path: str, vocab_size: int, path: str | None = None,
             cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Write the files (below the shared folder unless ``path`` is given) and
    return the per-document digest read back from them.  A smaller cache takes
    less memory and more time; results are the same."""
    spark = docs.sparkSession
    path = path or f"{checkpoint_dir(spark)}/token_blocks-{uuid.uuid4().hex}"
    write_blocks(docs, path, tokenizer_path, vocab_size, cache_entries=cache_entries)
    return read_documents(spark, path)


def default_tokenizer() -> tuple[str, int]:
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path).get_vocab_size()


@register("op6_token_pack")
def op6_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(documents(spark, sf_dir), *default_tokenizer())
