"""Structured Streaming jobs (G1-G6): the reference's polling loops and TTL
caches re-aimed at file-source streams.

Every job reads landed files with ``readStream``, checkpoints into the shared
folder named by ``spark.checkpoint.dir`` and appends what a micro-batch adds
through ``foreachBatch``.  A batch that runs a second time (lost executor, driver
restart) rewrites its own folder and reads only the batches before it, so the
result is the same.  A job started again with the same ``root`` goes on where
it ended.  After ``COMPACT_EVERY`` batches the deltas are merged into one
folder without superseded and expired rows: a batch reads that folder and a
bounded number of deltas, and expired rows leave the disk.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.operators import news
from riskfold.session import checkpoint_dir


COMPACT_EVERY = 16  # deltas after which they are merged into one folder


class DeltaTable:
    """A parquet table kept as one folder ``batch=<id>`` per micro-batch and,
    once there are many, one folder ``base=<id>`` for all batches up to it.

    A base counts when it is written completely; only then are the folders that
    it replaces deleted, so a job stopped at any point leaves a readable table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/batch={batch_id:012d}")

    def _folders(self, kind: str) -> list[int]:
        """Ids of the completely written folders of a kind."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=")
                      and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}/_SUCCESS")))

    def base(self) -> int:
        """The last batch of the newest base, -1 if there is none."""
        return max(self._folders("base"), default=-1)

    def batches(self) -> list[int]:
        """Ids of the batches that lie beside the base."""
        base = self.base()
        return [b for b in self._folders("batch") if b > base]

    def read(self, before: int | None = None) -> DataFrame | None:
        """All batches, or those before one: the table as it was then."""
        base = self.base()
        if before is not None and before <= base:
            raise ValueError(f"batches up to {base} are merged: no state before batch {before}")
        paths = [f"{self.root}/base={base:012d}"] if base >= 0 else []
        paths += [f"{self.root}/batch={b:012d}" for b in self.batches() if before is None or b < before]
        return self.spark.read.parquet(*paths) if paths else None

    def compact(self, before: int, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows,
                every: int | None = None) -> bool:
        """Merge the batches before ``before`` into one base, passing their rows
        through ``keep``, once there are ``every`` of them.  The running batch
        is not among them, so it can still be replayed."""
        waiting = [b for b in self.batches() if b < before]
        if len(waiting) < (COMPACT_EVERY if every is None else every):
            return False
        base = self.base()
        keep(self.read(before)).write.mode("overwrite").parquet(f"{self.root}/base={waiting[-1]:012d}")
        jvm = self.spark.sparkContext._jvm
        for name in [f"batch={b:012d}" for b in self._folders("batch") if b <= waiting[-1]] + ([f"base={base:012d}"] if base >= 0 else []):
            p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return True


def stream_root(spark: SparkSession, name: str, run: str | None = None) -> str:
    """Folder of one job's tables and checkpoints under the shared checkpoint
    folder; the same ``run`` resumes a job, none starts a new one."""
    return os.path.join(checkpoint_dir(spark), "streams", f"{name}-{run or uuid.uuid4().hex[:12]}")


def land(df: DataFrame, key: str, files: int, folder: str) -> str:
    """Write ``df`` as ``files`` landed files, split by the key's hash."""
    df.repartition(files, key).write.mode("overwrite").parquet(folder)
    return folder


def files_per_batch(df: DataFrame, batches: int) -> int:
    """Files of a micro-batch, for ``batches`` of them: as many files in all as
    ``df`` has splits, so none is larger than what a task reads anyway."""
    return -(-df.rdd.getNumPartitions() // batches)


def file_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_available(stream_writer, checkpoint: str, attempts: int = 3) -> None:
    """Process everything landed; after an error go on from the checkpoint,
    at most ``attempts`` times (G2)."""
    for attempt in range(1, attempts + 1):
        try:
            stream_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
            return
        except StreamingQueryException:
            if attempt == attempts:
                raise


class KeyedStore:
    """First row per key over all batches.  A batch adds its rows whose key
    is not stored yet, or stored with a later ``order`` (files may land out of
    order); reading keeps the first of each key.

    With ``ts`` and ``horizon_days`` the state is bounded: a key is remembered
    until its row is that much older than the newest one, and may come again
    after that (a key seen later than the horizon is new)."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], order: str, ts: str | None = None, horizon_days: int | None = None):
        self.table, self.keys, self.order = DeltaTable(spark, root), keys, order
        self.ts, self.horizon_days = ts, horizon_days

    def _live(self, rows: DataFrame) -> DataFrame:
        first = news.keep_first(rows, self.keys, self.order)
        return first if self.horizon_days is None else within_days(first, self.ts, self.horizon_days)

    def add(self, df: DataFrame, batch_id: int) -> None:
        self.table.compact(batch_id, self._live)
        first = news.keep_first(df, self.keys, self.order)
        stored = self.table.read(before=batch_id)
        if stored is not None:
            s = stored.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], F.col(self.order).alias("_o"))
            same = F.col(self.order) >= F.col("_o")
            for i, k in enumerate(self.keys):
                same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
            first = first.join(s, same, "left_anti")
        self.table.write(first, batch_id)

    def read(self, before: int | None = None) -> DataFrame | None:
        rows = self.table.read(before)
        return None if rows is None else self._live(rows)


def within_days(rows: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows at most ``days`` older than the newest one."""
    newest = rows.select(F.max(ts)).scalar()
    return rows.where(F.col(ts) >= newest - F.expr(f"INTERVAL {int(days)} DAYS"))


def dedup_stream(spark: SparkSession, events: DataFrame, keys: list[str], order: str, root: str, ts: str | None = None,
                 horizon_days: int | None = None) -> KeyedStore:
    """Only-new keys across cycles, the first by ``order`` stays."""
    store = KeyedStore(spark, f"{root}/table", keys, order, ts, horizon_days)
    run_available(events.writeStream.foreachBatch(store.add), f"{root}/checkpoint")
    return store


def latest_value_stream(spark: SparkSession, events: DataFrame, key: str, ts: str, value: str, root: str) -> DataFrame:
    """Latest value per key.  The aggregation's state holds one row per
    key; a batch appends only the keys it changed (update mode)."""
    table = DeltaTable(spark, f"{root}/table")
    agg = events.groupBy(key).agg(F.max_by(value, ts).alias("latest_value"), F.max(ts).alias("latest_ts"))

    def newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(F.max_by("latest_value", "latest_ts").alias("latest_value"), F.max("latest_ts").alias("latest_ts"))

    def batch(df: DataFrame, batch_id: int) -> None:
        table.compact(batch_id, newest)
        table.write(df, batch_id)

    run_available(agg.writeStream.outputMode("update").foreachBatch(batch), f"{root}/checkpoint")
    return newest(table.read())


def retention_stream(spark: SparkSession, events: DataFrame, ts: str, keep_days: int, root: str,
                     valid=None) -> tuple[DataFrame, DataFrame]:
    """G5 + G2: (rows within ``keep_days`` of the newest event, dead letters).

    Rows that fail ``valid`` are appended to the dead letters and do not stop
    the job.  Reading passes over expired rows by a filter that parquet's
    statistics answer; merging the deltas deletes them."""
    table, dead = DeltaTable(spark, f"{root}/table"), DeltaTable(spark, f"{root}/dead_letter")
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))

    def batch(df: DataFrame, batch_id: int) -> None:
        table.compact(batch_id, lambda rows: within_days(rows, ts, keep_days))
        dead.compact(batch_id)
        table.write(df.where(ok), batch_id)
        dead.write(df.where(~ok), batch_id)

    run_available(events.writeStream.foreachBatch(batch), f"{root}/checkpoint")
    return within_days(table.read(), ts, keep_days), dead.read()


def news_pipeline_stream(spark: SparkSession, raw: DataFrame, root: str, order: str = "Doc Id") -> KeyedStore:
    """G1 + G6: each cycle preprocesses the landed news (R11) and inserts new
    articles (K3); ``read(before=n)`` is the snapshot before cycle n."""
    store = KeyedStore(spark, f"{root}/articles", ["id"], "src_order")
    run_available(raw.writeStream.foreachBatch(lambda df, b: store.add(news.preprocess(df, order=order), b)),
                  f"{root}/checkpoint")
    return store


def news_cycle_stream(spark: SparkSession, raw: DataFrame, store, cycle: Callable[[DataFrame, str], None], root: str) -> None:
    """G1 + R16: every micro-batch of landed news is one ``cycle`` over the
    article, index and dead-letter tables of ``store``, committed as one unit
    under the batch's id: a replayed batch finds itself committed."""
    def batch(df: DataFrame, batch_id: int) -> None:
        if not store.committed(str(batch_id), "cycle"):
            cycle(df, str(batch_id))

    run_available(raw.writeStream.foreachBatch(batch), f"{root}/checkpoint")
