"""SimHash near-duplicates by bit-sliced comparison (op 8).

1. Fingerprints: A-Z lower-cased, words, 3-word shingles with repeats, XXH64
   (seed 42) of each; a bit is set when over half of the hashes have it.
2. Equal fingerprints are one class (pre-aggregated least doc_id), so copies
   are never paired.
3. Candidate groups of different fingerprints: the 64 bits are cut into
   ``radius + 3`` blocks; two fingerprints within ``radius`` bits agree on at
   least three whole blocks, so every choice of three blocks is a key.  A group
   above SPLIT members is dealt out again by parts of its remaining bits, of
   which one must agree too.  Fingerprints differ, so such a part holds at most
   2**(remaining bits - part bits) members (2**19 with the defaults): bounded by
   the width of a fingerprint, not by the data.
4. Inside a group fingerprints stand vertically: plane b holds bit b of 64
   members in one word.  One query updates the distances to 64 members with
   carry-save counters (ones, twos, over); words of members that all exceed the
   radius are abandoned.  From each group only a spanning forest of its links
   goes on, never all pairs.
5. Components of the links; every document gets its component's least doc_id.

Defined results: a text without words (null, empty, blanks) has fingerprint
zero, linked like any other; a text of fewer than three words is one shingle;
rows of one doc_id each keep their fingerprint; a null doc_id counts as the
largest (its component_id is null only if the whole component has none);
an empty table gives no rows; other columns of ``docs`` are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.llm.graph import components
from riskfold.llm.registry import register
from riskfold.llm.words import documents, id_or_last, id_or_null, slices, texts
from riskfold.session import cut_lineage

SHINGLE = 3
RADIUS = 2
SEED = 42
SPLIT = 4096

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    k = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(words) - k + 1].tolist()
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1:].tolist())], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 14):
        part = h[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, **longs: Column) -> DataFrame:
    """(id, ``longs``, fp) of every row; fp as the signed long with the same bits."""
    names = ["id", *longs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in texts(part)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*map(part.column, names), pa.array(fps)], names=[*names, "fp"])

    return (docs.select(id_or_last("doc_id").alias("id"), *(c.alias(n) for n, c in longs.items()), "text")
            .mapInArrow(run, ", ".join(f"{n} long" for n in [*names, "fp"])))


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    return [b.tolist() for b in np.array_split(np.array(bits), n)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def candidate_groups(fps: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """(members: array of fp) with every pair within ``radius`` in some group."""
    chosen = list(itertools.combinations(_blocks(list(range(64)), radius + 3), 3))
    keys = [sum(c, []) for c in chosen]
    rows = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(_mask(k))).alias("key"))
        for i, k in enumerate(keys)])).alias("t")).select("fp", "t.*")
    sizes = cut_lineage(rows.groupBy("table", "key").count().where("count > 1"))
    rows = rows.join(sizes, ["table", "key"])
    rest = [_blocks([b for b in range(64) if b not in k], radius + 1) for k in keys]
    part_masks = F.array(*[F.array(*[F.lit(_mask(p)) for p in r]) for r in rest])
    small = rows.where(F.col("count") <= split).select("table", "key", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("sub"), "fp")
    large = (rows.where(F.col("count") > split)
             .select("table", "key", "fp", F.posexplode(F.element_at(part_masks, F.col("table") + 1)).alias("part", "mask"))
             .select("table", "key", "part", F.col("fp").bitwiseAND(F.col("mask")).alias("sub"), "fp"))
    return (small.unionByName(large).groupBy("table", "key", "part", "sub").agg(F.collect_list("fp").alias("members"))
            .where(F.size("members") > 1).select("members"))


def planes_of(tiles: np.ndarray) -> np.ndarray:
    """(n, 64) fingerprints -> (n, 64) planes: word b holds bit b of the 64."""
    bits = np.unpackbits(np.ascontiguousarray(tiles).view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    packed = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8")[:, :, 0]


def within(queries: np.ndarray, planes: np.ndarray, radius: int) -> np.ndarray:
    """For each row: one query against 64 vertical members; bit j of the answer
    is set when member j lies within ``radius`` bits.  Counters are carry-save:
    digit k of all 64 distances is one word; rows whose members all exceed the
    radius are abandoned every eighth plane."""
    digits = radius.bit_length() + 1  # counts up to radius + 1 and an overflow
    alive = np.arange(len(queries))
    answer = np.zeros(len(queries), dtype=np.uint64)
    q, p = queries, planes
    count = [np.zeros(len(q), dtype=np.uint64) for _ in range(digits)]
    over = np.zeros(len(q), dtype=np.uint64)
    for b in range(64):
        carry = p[:, b] ^ (np.uint64(0) - ((q >> np.uint64(b)) & np.uint64(1)))
        for k in range(digits):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if b % 8 == 7:
            far = over | _above(count, radius)
            if b == 63:
                answer[alive] = ~far
                break
            stay = far != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not stay.all():
                alive, q, p, over = alive[stay], q[stay], p[stay], over[stay]
                count = [c[stay] for c in count]
                if not len(alive):
                    break
    return answer


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds ``radius``, by comparing digit by digit."""
    more = np.zeros_like(count[0])
    same = ~more
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            same &= count[k]
        else:
            more |= same & count[k]
            same &= ~count[k]
    return more


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indexes of a spanning forest of the links a[i] - b[i]."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            parent[x] = parent.get(y, y)
            x = y
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            kept.append(i)
    return np.array(kept, dtype=np.int64)


def group_links(members: list[np.ndarray], radius: int, lanes: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) spanning what lies within ``radius`` inside each group."""
    tiles, sizes = [], []
    for m in members:
        pad = np.zeros(-(-len(m) // 64) * 64, dtype=np.uint64)
        pad[:len(m)] = m
        tiles.append(pad.reshape(-1, 64))
        sizes.append(len(m))
    first_tile = np.cumsum([0] + [len(t) for t in tiles])
    members_at = np.concatenate(tiles)
    planes = planes_of(members_at)
    lefts, rights = [], []
    for g, n in enumerate(sizes):
        lefts.append(np.arange(n))
        rights.append(np.full(n, g))
    pos, grp = np.concatenate(lefts), np.concatenate(rights)
    size = np.array(sizes)[grp]
    n_tiles = -(-size // 64)
    out_a, out_b = [], []
    flat = members_at.reshape(-1)
    for step in range(int(n_tiles.max())):
        # query i meets the tile ``step`` places behind its own
        use = np.flatnonzero(pos // 64 + step < n_tiles)
        for i in range(0, len(use), lanes):
            u = use[i:i + lanes]
            tile = first_tile[grp[u]] + pos[u] // 64 + step
            query = flat[first_tile[grp[u]] * 64 + pos[u]]
            hit = within(query, planes[tile], radius)
            some = np.flatnonzero(hit)
            if not len(some):
                continue
            bits = np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, lane = np.nonzero(bits)
            r = some[r]
            other = (pos[u][r] // 64 + step) * 64 + lane
            ok = (other < size[u][r]) & (other > pos[u][r])
            out_a.append(query[r[ok]])
            out_b.append(flat[first_tile[grp[u][r[ok]]] * 64 + other[ok]])
            if sum(map(len, out_a)) > 1 << 16:
                a, b = np.concatenate(out_a), np.concatenate(out_b)
                keep = _forest(a, b)
                out_a, out_b = [a[keep]], [b[keep]]
    if not out_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    keep = _forest(a, b)
    return a[keep], b[keep]


def links(fps: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """(u, v) fingerprint pairs within ``radius`` that span all such pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            a, b = group_links(held, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

        for batch in batches:
            column = batch.column("members")
            for k in range(len(column)):
                m = column[k].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                held.append(m)
                total += -(-len(m) // 64)
                if total >= 4096:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    return candidate_groups(fps, radius, split).mapInArrow(run, "u long, v long").distinct()


def _classes(rows: DataFrame, radius: int, least: Column) -> DataFrame:
    """(fp, least, head) of every fingerprint in ``rows``: ``least`` of its rows
    and the fingerprint that names its component."""
    classes = cut_lineage(rows.groupBy("fp").agg(least.alias("least")))
    linked = components(links(classes.select("fp"), radius)).select(F.col("u").alias("fp"), F.col("v").alias("head"))
    return classes.join(linked, "fp", "left").withColumn("head", F.coalesce("head", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (long), component_id for every row of ``docs``."""
    rows = cut_lineage(fingerprints(docs, shingle))
    heads = _classes(rows, radius, F.min("id"))
    component = heads.groupBy("head").agg(F.min("least").alias("component"))
    named = heads.join(component, "head").select("fp", "component")
    return rows.join(named, "fp").select(
        id_or_null("id").alias("doc_id"), "fp", id_or_null("component").alias("component_id"))


def keep_first(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component of linked fingerprints: the least doc_id's, of
    several rows with that id the one with the least text hash.  Rows are told
    apart by (doc_id, 128 bits of text hash), so rows that share an id, or have
    none, stay as long as their texts are not linked."""
    key = {"h": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")}
    rows = cut_lineage(fingerprints(docs, shingle, **key))
    heads = (_classes(rows, radius, F.min(F.struct("id", *key)))
             .groupBy("head").agg(F.min("least").alias("least")).select("least.*"))
    # exact copies of a row are merged before the shuffle
    whole = F.struct(*docs.columns)
    kept = (docs.select(id_or_last("doc_id").alias("id"), *(c.alias(n) for n, c in key.items()), whole.alias("row"))
            .groupBy("id", *key).agg(F.min_by("row", F.xxhash64("row")).alias("row")))
    return kept.join(heads, ["id", *key], "left_semi").select("row.*")


@register("op8_simhash_groups")
def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
