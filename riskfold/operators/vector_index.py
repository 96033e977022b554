"""Stored vector index with coarse cells, exact top-k search
and pruned similar pairs (J12).

Cells.  ``fit_pivots`` runs a few k-means steps over a bounded sample of the
vectors (``SAMPLE_PER_PIVOT`` rows a pivot, the ones of least key hash); every
vector belongs to the cell of its nearest pivot.  Per cell the number of rows,
the least and greatest distance to the pivot and the greatest norm are kept:
one row a cell, at most ``MAX_CELLS`` of them, so pivots and cell statistics
travel inside task closures.

Bounds.  For a pivot at distance d of q and a vector x at distance r of the same
pivot, |q - x| >= |d - r|, and q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2.  A cell
whose bound is below what is already found is not read; nothing else is left
out, so results are exact however the pivots lie.  On vectors without any
structure (uniform on a sphere of many dimensions) no metric bound excludes
much, and every cell is read.

Search is two joins of (query, cell) probes with the rows of those cells: the
nearest cells first, whose k-th score then decides which other cells can still
matter.  Cells are split into parts of at most ``PART_ROWS`` rows and the
queries of a cell into blocks, so no group grows with the data.

Similar pairs are found tile by tile and leave a tile in slices of ``PAIR_ROWS``:
a tile that holds one big group of near copies takes no more memory than another.
``earliest_similar`` compares rows with the anchors of clusters and gives one row
per row and tile at most, however many anchors are near.
"""

from __future__ import annotations

import dataclasses
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold.session import checkpoint_dir, cut_lineage

MAX_CELLS = 1024
SAMPLE_PER_PIVOT = 16
PART_ROWS = 8192
QUERY_BLOCK = 2048
TILE_ROWS = 16384       # rows of the largest tile of similar pairs
TILES_PER_GROUP = 8     # a group is cut into about this many tiles, more only beyond TILES_PER_GROUP * TILE_ROWS rows
SCORE_ROWS = 512        # rows of a tile that are compared at once
PAIR_ROWS = 8192        # pairs of a tile that are scored and sent on at once
BATCH_ROWS = 1024       # rows whose distances to all pivots are held at once
PROBE_ROWS = 8          # the first probes hold at least this many rows a wanted hit
SLACK = 1e-6            # distances and dot products are compared with this margin
DIGITS = 6              # scores are rounded before they are ranked: ties do not hang on summation order


# --------------------------------------------------------------- helpers --
def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column (all of one length, no nulls) as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)


def sliced(batches, rows: int = BATCH_ROWS):
    """Arrow batches in slices of at most ``rows`` rows, empty ones left out."""
    for whole in batches:
        for start in range(0, whole.num_rows, rows):
            yield whole.slice(start, rows)


def stacked(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype="float64") for v in series])


def _frame(columns: dict) -> pd.DataFrame:
    """Text as plain objects: Arrow-backed strings come in chunks, which Spark's struct rows refuse."""
    return pd.DataFrame({c: pd.Series(v, dtype=object if len(v) and isinstance(v[0], str) else None) for c, v in columns.items()})


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to pivots (rows x pivots)."""
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def fit_pivots(vectors: DataFrame, key: str, vec: str, cells: int, unit: bool = True, steps: int = 4) -> np.ndarray:
    """At most ``cells`` pivots from a sample of SAMPLE_PER_PIVOT rows a cell."""
    return _fit(_sample(vectors, key, vec, cells, unit), cells, steps)


def _sample(vectors: DataFrame, key: str, vec: str, cells: int, unit: bool) -> np.ndarray:
    """SAMPLE_PER_PIVOT rows a cell, the ones of least key hash."""
    n = max(1, min(cells, MAX_CELLS)) * SAMPLE_PER_PIVOT
    there = vectors.where(F.col(vec).isNotNull()).select(F.col(vec).alias("v"), F.xxhash64(key).alias("h"))
    # each task sends n rows where an order is cut off: hashes first, then the vectors of the least ones only
    last = there.select("h").orderBy("h").limit(n).agg(F.max("h")).first()[0]
    rows = there.where(F.col("h") <= F.lit(last)).orderBy("h").limit(n).select("v").toPandas()
    if not len(rows):
        return np.zeros((1, 1))
    x = stacked(rows["v"])
    return unit_rows(x) if unit else x


def _fit(x: np.ndarray, cells: int, steps: int = 4) -> np.ndarray:
    pivots = x[:max(1, min(cells, MAX_CELLS))]
    for _ in range(steps):
        at = np.concatenate([distances(x[s:s + BATCH_ROWS], pivots).argmin(1) for s in range(0, len(x), BATCH_ROWS)])
        pivots = np.stack([x[at == c].mean(0) if (at == c).any() else pivots[c] for c in range(len(pivots))])
    return np.unique(pivots, axis=0)


def assign(vectors: DataFrame, pivots: np.ndarray, vec: str, unit: bool = True) -> DataFrame:
    """``vectors`` plus _cell, _dist (to its pivot) and _norm."""
    schema = T.StructType([*vectors.schema.fields, T.StructField("_cell", T.IntegerType()),
                           T.StructField("_dist", T.DoubleType()), T.StructField("_norm", T.DoubleType())])

    def near(batches):
        for b in sliced(batches):
            x = matrix(b.column(vec))
            x = unit_rows(x) if unit else x
            d = distances(x, pivots)
            at = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(at.astype("int32")), pa.array(d[np.arange(len(x)), at]), pa.array(np.linalg.norm(x, axis=1))],
                names=[*b.schema.names, "_cell", "_dist", "_norm"])

    return vectors.where(F.col(vec).isNotNull()).mapInArrow(near, schema)


def cell_statistics(assigned: DataFrame) -> pd.DataFrame:
    """n, least and greatest distance and greatest norm per cell (a row a cell)."""
    return (assigned.groupBy("_cell").agg(F.count("*").alias("n"), F.min("_dist").alias("rmin"), F.max("_dist").alias("rmax"),
                                          F.max("_norm").alias("nmax")).toPandas().set_index("_cell"))


# ----------------------------------------------------------------- index --
@dataclasses.dataclass
class CellIndex:
    """Rows below ``path``/rows, partitioned by cell; ``cells`` (index cell:
    n, rmin, rmax, nmax, parts) and the pivots of those cells are small."""
    spark: SparkSession
    path: str
    key: str
    schema: T.StructType
    pivots: np.ndarray
    cells: pd.DataFrame

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")


def build(vectors: DataFrame, key: str = "id", vec: str = "ivect", ticker: str = "ticker", path: str | None = None,
          cells: int | None = None) -> CellIndex:
    """V9: write the index of (key, ticker, vec) below ``path`` (the shared
    folder if none is given).  Rows without a vector are not indexed."""
    spark = vectors.sparkSession
    path = path or f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    lean = cut_lineage(vectors.select(F.col(key), F.col(ticker).cast("string").alias("ticker"), F.col(vec).alias("vec")))
    if cells is None:  # about as many cells as rows a cell
        cells = int(lean.count() ** 0.5)
    pivots = fit_pivots(lean, key, "vec", cells)
    assigned = assign(lean, pivots, "vec")
    stats = cell_statistics(assigned)
    stats["parts"] = -(-stats["n"] // PART_ROWS)
    used = sorted(stats.index)
    parts = F.array(*[F.lit(int(stats["parts"].get(c, 1))) for c in range(len(pivots))])
    rows = (assigned.withColumn("part", F.pmod(F.xxhash64(key), F.get(parts, F.col("_cell")).cast("long")).cast("int"))
            .select(key, "ticker", "vec", "part", F.col("_cell").alias("cell")))
    rows.repartition("cell", "part").write.partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(rows.schema.json(),)], "value string").coalesce(1).write.text(f"{path}/schema")
    described = [(int(c), [float(v) for v in pivots[c]], *[float(stats.loc[c, s]) for s in ("n", "rmin", "rmax", "nmax", "parts")]) for c in used]
    (spark.createDataFrame(described, "cell int, pivot array<double>, n double, rmin double, rmax double, nmax double, parts double")
     .coalesce(1).write.parquet(f"{path}/cells"))
    return open_index(spark, path, key)


def open_index(spark: SparkSession, path: str, key: str = "id") -> CellIndex:
    """The index stored below ``path``."""
    cells = spark.read.parquet(f"{path}/cells").toPandas().set_index("cell").sort_index()  # at most MAX_CELLS rows
    pivots = stacked(cells.pop("pivot")) if len(cells) else np.zeros((0, 1))
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/schema").first()[0]))
    return CellIndex(spark, path, key, schema, pivots, cells.astype({"n": int, "parts": int}))


# ---------------------------------------------------------------- search --
def _first_cells(d: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """Mask (queries x cells) of each query's nearest cells that hold ``least`` rows."""
    order = np.argsort(d, axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    mask = np.zeros(d.shape, dtype=bool)
    np.put_along_axis(mask, order, before < least, axis=1)
    return mask


def _probes(index: CellIndex, queries: DataFrame, k: int, kth: bool) -> DataFrame:
    """(qid, cell): the nearest cells of each query; with ``kth`` the others
    that can still hold a row of its column ``kth`` or better."""
    pivots, at = index.pivots, index.cells.index.to_numpy()
    sizes, rmin, rmax, nmax = (index.cells[c].to_numpy() for c in ("n", "rmin", "rmax", "nmax"))
    schema = T.StructType([queries.schema["qid"], T.StructField("cell", T.IntegerType())])

    def choose(batches):
        for b in batches:
            if not b.num_rows or not len(at):
                continue
            q = matrix(b.column("qvec"))
            d = distances(q, pivots)
            mask = _first_cells(d, sizes, k * PROBE_ROWS)
            if kth:
                gap = np.maximum(0, np.maximum(d - rmax, rmin - d) - SLACK)
                bound = ((q * q).sum(1)[:, None] + (nmax ** 2)[None, :] - gap ** 2) / 2
                floor = b.column("kth").to_numpy(zero_copy_only=False)
                floor = np.where(np.isnan(floor.astype("float64")), -np.inf, floor.astype("float64"))
                mask = ~mask & (bound + SLACK >= floor[:, None])
            i, c = np.nonzero(mask)
            yield pa.RecordBatch.from_arrays([b.column("qid").take(pa.array(i)), pa.array(at[c].astype("int32"))], names=["qid", "cell"])

    return queries.select("qid", "qvec", *(["kth"] if kth else [])).mapInArrow(choose, schema)


def _score(index: CellIndex, queries: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """Best k rows of each probed (query, part of a cell)."""
    spark, key = index.spark, index.key
    probes = cut_lineage(probes)
    visited = {r["cell"]: r["n"] for r in probes.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    if not visited:
        schema = T.StructType([queries.schema["qid"], index.rows().schema[key], T.StructField("score", T.DoubleType())])
        return spark.createDataFrame([], schema)
    layout = spark.createDataFrame([(int(c), int(index.cells["parts"][c]), -(-n // QUERY_BLOCK)) for c, n in visited.items()],
                                   "cell int, parts int, blocks int")
    layout = F.broadcast(layout)  # at most MAX_CELLS rows
    asked = (probes.join(layout, "cell").join(queries.select("qid", "qvec", "qticker"), "qid")
             .withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int"))
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    rows = (index.rows().where(F.col("cell").isin([int(c) for c in visited])).join(layout, "cell")
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    return _best(asked, rows, key, k)


def _best(asked: DataFrame, rows: DataFrame, key: str, k: int) -> DataFrame:
    """Best k rows per query inside each (cell, part, block) that both sides share."""
    groups = ["cell", "part", "block"]
    asked = asked.select(*groups, "qid", "qvec", "qticker")
    rows = rows.select(*groups, key, "ticker", "vec")
    schema = T.StructType([asked.schema["qid"], rows.schema[key], T.StructField("score", T.DoubleType())])

    def best(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = {"qid": [], key: [], "score": []}
        if len(q) and len(x):
            scores = np.round(unit_rows(stacked(x["vec"])) @ stacked(q["qvec"]).T, DIGITS)
            ids, tickers = x[key].to_numpy(), x["ticker"].to_numpy()
            for j, (qid, only) in enumerate(zip(q["qid"], q["qticker"])):
                at = np.arange(len(x)) if only is None or only != only else np.flatnonzero(tickers == only)
                s = scores[at, j]
                if len(at) > k:
                    keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                    at, s = at[keep], s[keep]
                top = np.lexsort((ids[at], -s))[:k]
                out["qid"] += [qid] * len(top)
                out[key] += ids[at[top]].tolist()
                out["score"] += s[top].tolist()
        return _frame(out)

    return asked.groupBy(*groups).cogroup(rows.groupBy(*groups)).applyInPandas(best, schema)


def _top(hits: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col(key))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: CellIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """V10 + J13 + P8 + T6: the k best rows of the index for each query (qid,
    qvec, qticker; a null qticker means every ticker) by dot product with the
    unit vector, ties by key: qid, key, score, rank."""
    q = cut_lineage(queries.select("qid", "qvec", F.col("qticker").cast("string").alias("qticker")))
    first = cut_lineage(_top(_score(index, q, _probes(index, q, k, False), k), index.key, k).drop("rank"))
    kth = first.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    more = _score(index, q, _probes(index, q.join(kth, "qid", "left"), k, True), k)
    return _top(first.unionByName(more), index.key, k)


def scan(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "id", vec: str = "vec", ticker: str = "ticker") -> DataFrame:
    """The result of ``search`` for vectors without a stored index: every row is
    compared, in parts of about PART_ROWS rows and blocks of QUERY_BLOCK queries."""
    lean = vectors.where(F.col(vec).isNotNull()).select(key, F.col(ticker).cast("string").alias("ticker"), F.col(vec).alias("vec"))
    asked = queries.select("qid", "qvec", F.col("qticker").cast("string").alias("qticker"))
    parts, blocks = (max(1, -(-df.count() // size)) for df, size in ((lean, PART_ROWS), (asked, QUERY_BLOCK)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.withColumn("cell", F.lit(0)).withColumn("block", deal("qid", blocks)).withColumn("part", every(parts))
    rows = lean.withColumn("cell", F.lit(0)).withColumn("part", deal(key, parts)).withColumn("block", every(blocks))
    return _top(_best(asked, rows, key, k), key, k)


def visited_share(index: CellIndex, queries: DataFrame, k: int = 10) -> float:
    """Share of all (query, row) comparisons that ``search`` makes."""
    q = cut_lineage(queries.select("qid", "qvec", F.col("qticker").cast("string").alias("qticker")))
    sizes = index.spark.createDataFrame([(int(c), int(n)) for c, n in index.cells["n"].items()], "cell int, n long")
    first = _probes(index, q, k, False)
    kth = _top(_score(index, q, first, k), index.key, k).groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    seen = first.unionByName(_probes(index, q.join(kth, "qid", "left"), k, True)).join(F.broadcast(sizes), "cell")
    return (seen.agg(F.sum("n")).first()[0] or 0) / max(1, q.count() * int(index.cells["n"].sum()))


# ---------------------------------------------------------- similar pairs --
def _visits(rows: DataFrame, pivots: np.ndarray, stats: pd.DataFrame, threshold: float) -> DataFrame:
    """``rows`` plus _visit: the cells of ``stats`` that can hold a partner, of rows
    with a cell of their own only later ones.  With |x - y|^2 = |x|^2 + |y|^2 - 2 x.y
    a partner y of cell B is at most sqrt(|x|^2 + nmax_B^2 - 2 threshold) away, and
    B's pivot rmax_B further."""
    at = np.array(sorted(stats.index), dtype=np.int64)
    rmax, nmax = (stats.loc[at, c].to_numpy() for c in ("rmax", "nmax"))
    schema = T.StructType([*rows.schema.fields, T.StructField("_visit", T.ArrayType(T.IntegerType()))])

    def reach(batches):
        for b in sliced(batches):
            x = matrix(b.column("_v"))
            norm = np.linalg.norm(x, axis=1)
            room = norm[:, None] ** 2 + nmax[None, :] ** 2 - 2 * threshold
            near = distances(x, pivots[at]) <= np.sqrt(np.maximum(room, 0)) + rmax[None, :] + SLACK
            mask = near & (room >= -SLACK)
            if "_cell" in b.schema.names:
                mask &= at[None, :] > b.column("_cell").to_numpy()[:, None]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([at[m].tolist() for m in mask], pa.list_(pa.int32()))],
                                             names=[*b.schema.names, "_visit"])

    return rows.mapInArrow(reach, schema)


TILE_COLUMNS = ["_g", "_cell", "_kind", "_u", "_w", "_side", "_k", "_o", "_v"]


def _tile_rows(largest: int, tile_size: int) -> int:
    return max(tile_size, min(TILE_ROWS, -(-largest // TILES_PER_GROUP)))


def _reach_share(x: np.ndarray, pivots: np.ndarray, threshold: float) -> float:
    """Share of the cells that the bound leaves to a row, over a sample."""
    norm = np.linalg.norm(x, axis=1)
    parts = [slice(s, s + BATCH_ROWS) for s in range(0, len(x), BATCH_ROWS)]
    rmax, nmax = np.zeros(len(pivots)), np.zeros(len(pivots))
    for part in parts:
        d = distances(x[part], pivots)
        at = d.argmin(1)
        np.maximum.at(rmax, at, d[np.arange(len(d)), at])
        np.maximum.at(nmax, at, norm[part])
    left = 0
    for part in parts:
        room = norm[part, None] ** 2 + nmax[None, :] ** 2 - 2 * threshold
        left += int(((distances(x[part], pivots) <= np.sqrt(np.maximum(room, 0)) + rmax) & (room >= 0)).sum())
    return left / (len(x) * len(pivots))


def _pair_layout(vectors: DataFrame, key: str, vec: str, largest: int, tile_size: int, threshold: float) -> tuple[np.ndarray, int]:
    """Pivots and rows of a tile: four cells a tile of ``tile_size`` rows where
    the bounds leave few of them; else larger tiles, one cell each (smaller ones
    would only mean more copies of a row)."""
    cells = 4 * -(-largest // tile_size)
    x = _sample(vectors, key, vec, cells, False)
    pivots = _fit(x, cells)
    if _reach_share(x, pivots, threshold) * len(pivots) <= 2 * TILES_PER_GROUP:
        return pivots, tile_size
    grown = _tile_rows(largest, tile_size)
    return _fit(x, -(-largest // grown)), grown


def similar_pairs(vectors: DataFrame, threshold: float, key: str = "id", group: str = "ticker", vec: str = "vec",
                  order: str | None = None, tile_size: int = 2048) -> DataFrame:
    """All pairs (a, b) inside a group with order(a) < order(b) and
    dot(a, b) >= threshold.  Exact.

    A group of at most ``tile_size`` rows is one tile.  Larger groups are cut
    into cells; a row meets the rows of its own cell and, as a visitor, those of
    the later cells that its bound leaves.  Members and visitors of a cell are
    dealt into tiles of about ``tile_size`` rows, so a task holds two tiles.

    A row is copied once per tile that it meets.  Where the bounds leave many
    cells the tiles grow with the largest group, to an eighth of it (at most
    TILE_ROWS rows), so a row's copies stay few while the group grows."""
    return _pairs(*_tiles(vectors, threshold, key, group, vec, order or key, tile_size), threshold)


def compared_share(vectors: DataFrame, threshold: float, key: str = "id", group: str = "ticker", vec: str = "vec",
                   tile_size: int = 2048) -> float:
    """Share of all pairs inside the groups that ``similar_pairs`` compares."""
    tiles = _tiles(vectors, threshold, key, group, vec, key, tile_size)[0]
    n = tiles.groupBy("_g", "_cell", "_kind", "_u", "_w").agg(
        F.sum(F.when(F.col("_side") == 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("_side") == 1, 1).otherwise(0)).alias("b"))
    same = (F.col("_kind") == 0) & (F.col("_u") == F.col("_w"))
    made = n.agg(F.sum(F.when(same, F.col("a") * (F.col("a") - 1) / 2).otherwise(F.col("a") * F.col("b")))).first()[0] or 0
    total = vectors.where(F.col(vec).isNotNull()).groupBy(F.coalesce(F.col(group).cast("string"), F.lit("UNK"))).count().agg(
        F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 1
    return float(made) / max(1.0, float(total))


def _tiles(vectors: DataFrame, threshold: float, key: str, group: str, vec: str, order: str, tile_size: int):
    """Rows dealt to tile pairs: _g, _cell, _kind (0 members, 1 visitors), _u,
    _w, _side, _k, _o, _v."""
    v = _lean(vectors, key, group, vec, order)
    sizes = v.groupBy("_g").agg(F.count("*").alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    whole = [F.lit(1).alias("_parts"), F.lit(0).alias("_blocks")]
    visitors = None
    if largest <= tile_size:
        members = v.select("_g", F.lit(-1).alias("_cell"), "_k", "_o", "_v", *whole)
    else:
        v = v.join(sizes, "_g")
        large = v.where(F.col("_n") > tile_size)
        small = v.where(F.col("_n") <= tile_size).select("_g", F.lit(-1).alias("_cell"), "_k", "_o", "_v", *whole)
        pivots, tile_size = _pair_layout(large, "_k", "_v", largest, tile_size, threshold)
        assigned = cut_lineage(assign(large, pivots, "_v", unit=False))
        placed = _visits(assigned, pivots, cell_statistics(assigned), threshold)
        guests = placed.select("_g", F.explode("_visit").alias("_cell"), "_k", "_o", "_v")
        counts = _dealt(assigned, guests, tile_size)
        members = small.unionByName(assigned.join(counts, ["_g", "_cell"]).select(small.columns))
        visitors = guests.join(counts, ["_g", "_cell"])
    own = members.withColumn("_t", _deal("_parts")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    own = own.withColumn("_kind", F.lit(0)).withColumn("_u", F.least("_t", "_other")).withColumn("_w", F.greatest("_t", "_other"))
    tiles = own.withColumn("_side", F.when((F.col("_t") == F.col("_w")) & (F.col("_u") != F.col("_w")), 1).otherwise(0)).select(TILE_COLUMNS)
    if visitors is not None:
        tiles = tiles.unionByName(_hosted(members, visitors))
    key_type, order_type = vectors.schema[key].dataType, vectors.schema[order].dataType
    return tiles, key_type, order_type


def _lean(vectors: DataFrame, key: str, group: str, vec: str, order: str) -> DataFrame:
    return vectors.where(F.col(vec).isNotNull()).select(
        F.coalesce(F.col(group).cast("string"), F.lit("UNK")).alias("_g"), F.col(key).alias("_k"), F.col(order).alias("_o"),
        F.col(vec).alias("_v"))


def _deal(n: str) -> Column:
    return F.pmod(F.xxhash64("_k"), F.col(n)).cast("int")


def _dealt(assigned: DataFrame, guests: DataFrame, tile_size: int) -> DataFrame:
    """Tiles of members (_parts) and of visitors (_blocks) per group and cell."""
    counts = (assigned.groupBy("_g", "_cell").agg(F.count("*").alias("_m"))
              .join(guests.groupBy("_g", "_cell").agg(F.count("*").alias("_s")), ["_g", "_cell"], "left")
              .select("_g", "_cell", F.ceil(F.col("_m") / tile_size).cast("int").alias("_parts"),
                      F.ceil(F.coalesce("_s", F.lit(0)) / tile_size).cast("int").alias("_blocks")))
    return cut_lineage(counts)


def _hosted(members: DataFrame, visitors: DataFrame) -> DataFrame:
    """Members (side 0) and visitors (side 1) of a cell, each tile of the ones with each of the others."""
    hosts = (members.where("_blocks > 0").withColumn("_u", _deal("_parts"))
             .withColumn("_w", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn("_side", F.lit(0)))
    guests = (visitors.withColumn("_w", _deal("_blocks"))
              .withColumn("_u", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumn("_side", F.lit(1)))
    hosts, guests = (side.withColumn("_kind", F.lit(1)).select(TILE_COLUMNS) for side in (hosts, guests))
    return hosts.unionByName(guests)


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as ``matrix`` gives them, but floats as they are."""
    if not len(column) or not pa.types.is_float32(column.type.value_type):
        return matrix(column)
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of the pairs (i, j) in double precision."""
    return np.einsum("pd,pd->p", x[i].astype("float64"), y[j].astype("float64"))


def _scores(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray, float]]:
    """Scores of SCORE_ROWS rows of x at once with all of y: first row, scores and
    what they can be off by.  Floats are multiplied as floats: half the time and
    memory, and only scores this near a threshold need ``_exact``."""
    off = 0.0
    if x.dtype == y.dtype == np.float32:
        norms = [float(np.sqrt(np.einsum("pd,pd->p", z, z, dtype="float64").max(initial=0))) for z in (x, y)]
        off = (x.shape[1] + 8) * 2.0 ** -23 * norms[0] * norms[1]
        if not off < 1e30:  # too large for floats, or no numbers
            x, y, off = x.astype("float64"), y.astype("float64"), 0.0
    for start in range(0, len(x), SCORE_ROWS):
        yield start, x[start:start + SCORE_ROWS] @ y.T, off


def _pairs(tiles: DataFrame, key_type: T.DataType, order_type: T.DataType, threshold: float) -> DataFrame:
    schema = T.StructType([T.StructField("group", T.StringType()), T.StructField("a", key_type), T.StructField("b", key_type),
                           T.StructField("a_order", order_type), T.StructField("b_order", order_type), T.StructField("sim", T.DoubleType())])

    names = [f"{a}{b}" for a in ("_k", "_o") for b in ("a", "b")]

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        same = rows["_kind"][0].as_py() == 0 and rows["_u"][0].as_py() == rows["_w"][0].as_py()
        left = rows if same else rows.filter(pc.equal(rows["_side"], 0))
        right = rows if same else rows.filter(pc.equal(rows["_side"], 1))
        group = rows["_g"][0]
        x, y = _rows(left["_v"]), _rows(right["_v"])
        left, right = (side.select(["_k", "_o"]) for side in (left, right))
        del rows
        if not len(left) or not len(right):
            return
        for start, s, off in _scores(x, y):
            near = np.nonzero(s >= threshold - off)
            for at in range(0, len(near[0]), PAIR_ROWS):
                i, j = (side[at:at + PAIR_ROWS] for side in near)
                sim = _exact(x, y, i + start, j) if off else s[i, j].astype("float64")
                i, j, sim = (side[sim >= threshold] for side in (i + start, j, sim))
                pairs = pa.table([side[c].take(pa.array(at)) for c in ("_k", "_o") for side, at in ((left, i), (right, j))]
                                 + [pa.array(sim)], names=[*names, "sim"])
                pairs = pairs.filter((pc.less if same else pc.not_equal)(pairs["_oa"], pairs["_ob"]))
                swap = pc.greater(pairs["_oa"], pairs["_ob"])
                ends = [pc.if_else(swap, pairs[u], pairs[w]) for u, w in (("_kb", "_ka"), ("_ka", "_kb"), ("_ob", "_oa"), ("_oa", "_ob"))]
                yield from pa.table([pa.repeat(group, len(pairs)), *ends, pairs["sim"]], names=schema.names).to_batches()

    return tiles.groupBy("_g", "_cell", "_kind", "_u", "_w").applyInArrow(block, schema)


def earliest_similar(rows: DataFrame, anchors: DataFrame, threshold: float, key: str = "id", group: str = "ticker", vec: str = "vec",
                     order: str | None = None, tile_size: int = 2048) -> DataFrame:
    """J12 between two tables: of every row with anchors of its group at dot(row,
    anchor) >= threshold the earliest of them (key, anchor).  Exact, by the cells
    and bounds of ``similar_pairs``: the anchors are members, the rows visitors."""
    order = order or key
    members, visitors = (_lean(side, key, group, vec, order) for side in (anchors, rows))
    largest = members.groupBy("_g").count().agg(F.max("count")).first()[0]
    if not largest:
        none = T.StructType([rows.schema[key], T.StructField("anchor", anchors.schema[key].dataType)])
        return rows.sparkSession.createDataFrame([], none)
    pivots, tile_size = _pair_layout(members, "_k", "_v", largest, tile_size, threshold)
    assigned = cut_lineage(assign(members, pivots, "_v", unit=False))
    placed = _visits(visitors, pivots, cell_statistics(assigned), threshold)
    guests = placed.select("_g", F.explode("_visit").alias("_cell"), "_k", "_o", "_v")
    counts = _dealt(assigned, guests, tile_size)
    tiles = _hosted(assigned.join(counts, ["_g", "_cell"]), guests.join(counts, ["_g", "_cell"]))
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("anchor", anchors.schema[key].dataType),
                           T.StructField("_o", anchors.schema[order].dataType)])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches)
        left, right = (whole.filter(pc.equal(whole["_side"], side)) for side in (1, 0))
        right = right.take(pc.sort_indices(right["_o"]))  # the first similar one is the earliest
        x, y = _rows(left["_v"]), _rows(right["_v"])
        left, right = (side.select(["_k", "_o"]) for side in (left, right))
        del whole
        if not len(left) or not len(right):
            return
        for start, s, off in _scores(x, y):
            near = s >= threshold + off
            if off:
                unsure = np.nonzero((s >= threshold - off) & ~near)
                for at in range(0, len(unsure[0]), PAIR_ROWS):
                    i, j = (side[at:at + PAIR_ROWS] for side in unsure)
                    near[i, j] = _exact(x, y, i + start, j) >= threshold
            i = np.flatnonzero(near.any(1))
            if len(i):
                first = right.take(pa.array(near[i].argmax(1)))
                yield from pa.table([left["_k"].take(pa.array(i + start)), first["_k"], first["_o"]], names=schema.names).to_batches()

    hits = tiles.groupBy("_g", "_cell", "_u", "_w").applyInArrow(block, schema)
    return hits.groupBy(key).agg(F.min_by("anchor", "_o").alias("anchor"))


def score_of(a: Column, b: Column) -> Column:
    """Rounded dot product of two array columns, as ``search`` ranks it."""
    return F.round(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x), DIGITS)
