"""Harmonic packing of documents into token sequences (op 12).

A sequence holds at most ``capacity`` tokens.  Lengths are partitioned into
reciprocal-capacity classes: class k holds the lengths in (capacity / (k + 1),
capacity / k], and k pieces of class k always fit one sequence, so a class is
packed by counting to k and no worker has to know another one's bins.

Documents are cut so that classes waste little.  A document gives whole
sequences (class 1) first.  A remainder in a class below ``fine`` gives a head
of exactly capacity // k tokens, k - 1 being its class, and goes on with its
tail; from class ``fine`` on a remainder stays whole, as k lengths of class k
leave less than 1 / (k + 1) of a sequence free.

1. Each worker encodes its documents and fills the bins of every class on its
   own; what it holds at its end (fewer than k pieces of class k) are its
   leftovers.  All pieces are written once, as Parquet.
2. The leftovers of all workers are numbered per class by prefix counts over
   the workers, and k consecutive ones fill a bin.
3. Fewer than k pieces of each class remain, a number set by ``capacity`` alone
   (under 2 * capacity * ln(capacity) pieces).  They are laid end to end and cut at
   every ``capacity`` tokens; the last part is cut at powers of two, which
   need no padding.

Bounds: a worker holds fewer than k pieces a class; steps 2 and 3 move the
leftovers alone, and their windows hold one row a worker or k rows a bin.

Defined results: a null or empty text is the end id alone; repeated rows and
null doc_ids are documents of their own; an empty table gives no pieces; a
document of any length is encoded whole; columns other than the two named are
ignored.
"""

from __future__ import annotations

import re
import sys
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskfold.llm.registry import register
from riskfold.llm.words import documents, slices, texts, worker_cache
from riskfold.session import checkpoint_dir

CAPACITY = 4096
FINE = 16
END_ID = 2
OWNER = "harmonic_pack"
assert sys.byteorder == "little"  # ids are written as they lie in memory
CACHE_BYTES = 96 << 20  # of keys and ids, in each of two generations
FLUSH_BYTES = 2 << 20
BATCH_ROWS = 1 << 14

PIECE_SCHEMA = ("doc_id long, start long, length long, doc_tokens long, class int, worker int, "
                "nr long, bin long, offset long, ids binary")
STREAM_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: the three steps number their sequences in ranges of their own
STEP = 1 << 60


def classes_of(length: int, capacity: int = CAPACITY, fine: int = FINE) -> list[tuple[int, int]]:
    """(class, length) of the pieces of a document, in order."""
    out = [(1, capacity)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if k >= fine or k * rest == capacity:
            return [*out, (k, rest)]
        head = capacity // (k + 1)
        out.append((k + 1, head))
        rest -= head
    return out


class _Pieces(dict):
    """Piece -> ids, in two generations of about CACHE_BYTES; pieces in use move
    to the young one, the old one is dropped whole."""

    def __init__(self, coder: WordIds):
        super().__init__()
        self.coder, self.old, self.held = coder, {}, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.coder.piece(piece)
        self[piece] = ids
        self.held += len(piece) + len(ids) + 160
        return ids

    def age(self) -> None:
        if self.held > CACHE_BYTES:
            self.old, self.held = self.copy(), 0
            self.clear()


class WordIds:
    """The tokenizers library with a cache over pieces of text.

    The vocabulary's pre-tokenizer drops white space and none of its tokens
    crosses it, so a text's ids are those of its blank-delimited words in a row.
    In texts of ``PLAIN`` characters, whose lower case is known, marks behind or
    before letters and digits are pieces of their own too, as the pre-tokenizer
    cuts there (an apostrophe may belong to a contraction: marks next to one
    stay with their word).  That holds where normaliser and pre-tokenizer are of
    the kinds named in ``local``; other tokenizers, texts with special tokens and
    texts with characters on which engines may differ about being white space
    are encoded whole.
    """

    ODD = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")
    #: bytes of ASCII text and of U+00C0 .. U+017F, and the characters there that are no
    #: letters or not one character in both cases and in NFC
    PLAIN = bytes([9, 10, 11, 12, 13, *range(32, 127), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5])
    NOT_PLAIN = tuple("\u00d7\u00f7\u0130\u0131\u0149")
    MARKS = re.compile(r"(?<![!-/:-@\[-`{-~])[!-&(-/:-@\[-`{-~]++(?!')")
    LETTERS = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff" + "".join(filter(str.islower, map(chr, [*range(0x100, 0x130), *range(0x132, 0x149), *range(0x14A, 0x180)]))) + "]+")

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = tuple(t["content"] for t in spec.get("added_tokens", []))
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = [n["type"] for n in norm.get("normalizers", [norm] if norm else [])]
        cuts = pre.get("pretokenizers", [])
        self.local = (steps == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
                      and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
                      and cuts[0]["pattern"].get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
                      and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"])
        if self.local:
            self.model, cut = self.tokenizer.model.tokenize, self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.bytes_as_text = str.maketrans({c: cut(c)[0][0] for c in map(chr, range(0x180)) if self.LETTERS.fullmatch(c)})
        self.pieces = _Pieces(self)

    @classmethod
    def of(cls, path: str) -> WordIds:
        """One per worker process, so later tasks find a warm cache."""
        found = worker_cache(OWNER)
        if path not in found:
            found[path] = cls(path)
        return found[path]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        if self.LETTERS.fullmatch(piece):  # one pre-token: straight to the model
            text = piece if piece.isascii() else piece.translate(self.bytes_as_text)
            return array("I", [t.id for t in self.model(text)]).tobytes()
        if self.is_plain(piece):
            parts = self.MARKS.sub(r" \g<0> ", piece.lower()).split()
            if len(parts) > 1:
                return b"".join(map(self.pieces.__getitem__, parts))
        return self.whole(piece)

    def is_plain(self, text: str) -> bool:
        return not text.encode().translate(None, self.PLAIN) and (text.isascii() or not any(c in text for c in self.NOT_PLAIN))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the text."""
        if not self.local or any(s in text for s in self.special):
            return self.whole(text)
        if self.is_plain(text):
            pieces = text.lower().split()
        elif not self.ODD.search(text):
            pieces = text.split()
        else:
            return self.whole(text)
        self.pieces.age()
        return b"".join(map(self.pieces.__getitem__, pieces))


def write_pieces(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, doc_id: str = "doc_id",
                 text: str = "text", capacity: int = CAPACITY, fine: int = FINE) -> None:
    """Step 1.  Pieces of full bins have ``bin`` and ``offset``; leftovers have
    ``nr``, their number among the worker's leftovers of the class."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, bins, held = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], dtype="<u4").tobytes()
        waiting: dict[int, list[tuple]] = {}
        rows: list[tuple] = []
        coder = WordIds.of(tokenizer_path)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * 10
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64()] * 3 + [pa.binary()]
            names = ["doc_id", "start", "length", "doc_tokens", "class", "worker", "nr", "bin", "offset", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for part in slices(batches, "text", owner=OWNER):
            for key, t in zip(part.column("doc_id").to_pylist(), texts(part)):
                ids = coder.encode(t) + end
                start, total = 0, len(ids) // 4
                for k, length in classes_of(total, capacity, fine):
                    group = waiting.setdefault(k, [])
                    group.append((key, start, length, total, k, ids[4 * start:4 * (start + length)]))
                    start += length
                    if len(group) == k:
                        offset = 0
                        for a, b, n, m, c, x in group:
                            rows.append((a, b, n, m, c, worker, None, bins, offset, x))
                            offset += n
                        held += 4 * offset
                        bins += 1
                        group.clear()
                    if held > FLUSH_BYTES or len(rows) > BATCH_ROWS:
                        yield flush()
                        rows.clear()
                        held = 0
        for k in sorted(waiting):
            rows += [(a, b, n, m, c, worker, nr, None, None, x) for nr, (a, b, n, m, c, x) in enumerate(waiting[k])]
        if rows:
            yield flush()

    (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
     .mapInArrow(pack, PIECE_SCHEMA).write.parquet(path))


def _end_to_end(capacity: int):
    """Step 3 over the ordered rest: cut at every ``capacity`` tokens, the last
    part at powers of two."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [r for b in batches for r in b.to_pylist()]
        total = sum(r["length"] for r in rest)
        sizes = [capacity] * (total // capacity)
        sizes += [1 << b for b in reversed(range(capacity.bit_length())) if (total % capacity) >> b & 1]
        out, place, used = [], 0, 0
        for r in rest:
            at = 0
            while at < r["length"]:
                n = min(r["length"] - at, sizes[place] - used)
                out.append({"doc_id": r["doc_id"], "start": r["start"] + at, "length": n, "doc_tokens": r["doc_tokens"],
                            "sequence_id": 3 * STEP + place, "offset": used, "ids": r["ids"][4 * at:4 * (at + n)]})
                at, used = at + n, used + n
                if used == sizes[place]:
                    place, used = place + 1, 0
        kinds = [(n, pa.binary() if n == "ids" else pa.int64()) for n in
                 ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))
    return cut


def read_pieces(spark: SparkSession, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Steps 2 and 3: every piece with its place.  doc_id, start, length,
    doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    pieces = spark.read.schema(PIECE_SCHEMA).parquet(path)
    result = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    own = pieces.where("bin is not null").withColumn(
        "sequence_id", F.lit(STEP) + F.shiftleft(F.col("worker").cast("long"), 32) + F.col("bin"))
    left = pieces.where("bin is null").drop("bin", "offset")
    # one row per class and worker
    counts = left.groupBy("class", "worker").agg(F.count("*").alias("n"))
    before = (counts.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("worker")) - F.col("n"))
              .withColumn("full", F.floor(F.sum("n").over(Window.partitionBy("class")) / F.col("class")))
              .drop("n"))
    placed = (left.join(before, ["class", "worker"])
              .withColumn("position", F.col("before") + F.col("nr"))
              .withColumn("bin", F.expr("position div class")))
    in_bin = Window.partitionBy("class", "bin").orderBy("position")
    pooled = (placed.where("bin < full")
              .withColumn("offset", F.sum("length").over(in_bin) - F.col("length"))
              .withColumn("sequence_id", F.lit(2 * STEP) + F.shiftleft(F.col("class").cast("long"), 40) + F.col("bin")))
    # fewer than k pieces of class k, whatever the input: one task
    rest = (placed.where("bin >= full").select("doc_id", "start", "length", "doc_tokens", "class", "position", "ids")
            .repartition(1).sortWithinPartitions("class", "position").drop("class", "position")
            .mapInArrow(_end_to_end(capacity), STREAM_SCHEMA))
    return own.select(result).unionByName(pooled.select(result)).unionByName(rest.select(result))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, path: str | None = None,
         capacity: int = CAPACITY, fine: int = FINE) -> DataFrame:
    """Pieces of all documents; the files lie below the shared folder unless
    ``path`` is given."""
    spark = docs.sparkSession
    path = path or f"{checkpoint_dir(spark)}/harmonic-{uuid.uuid4().hex}"
    write_pieces(docs, path, tokenizer_path, end_id, capacity=capacity, fine=fine)
    return read_pieces(spark, path, capacity)


def sequences(pieces: DataFrame, pad_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, n_tokens, ids: the pieces in a row, padded to ``capacity``
    unless they are a power of two long."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))  # at most ``capacity`` pieces
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), inside.alias("rows"))
    pad = F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()),
                   F.when(F.bit_count("n_tokens") == 1, 0).otherwise(capacity - F.col("n_tokens")).cast("int"))
    return whole.select("sequence_id", "n_tokens", F.concat(
        F.unhex(F.array_join(F.transform("rows", lambda r: F.hex(r["ids"])), "")), F.unhex(pad)).alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@register("op12_harmonic_pack")
def op12_harmonic_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_tokenizer()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
