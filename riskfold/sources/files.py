"""File sources and sinks.

Readers always pass an explicit schema; writers are whole-DataFrame
writes (one atomic job per table, no per-row commits).  Paths are
cluster paths (the shared folder of the session), never machine-local.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold import schemas
from riskfold.functions.numbers import extract_number
from riskfold.sources.versioned import VersionedStore


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_csv(df: DataFrame, path: str) -> None:
    """K1: CSV with header, overwrite, no index column."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """CSV with a default schema when missing; a BOM on the first column
    name is tolerated.  ``multi_line``: fields may hold quoted line breaks; a
    file is then one task, else large files are split."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = (spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"')
           .option("escape", '"').option("encoding", "UTF-8").csv(path))
    raw = raw.toDF(*[c.lstrip("\ufeff") for c in raw.columns])
    return schemas.conform(raw, T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields]))


def load_universe(spark: SparkSession, path: str) -> DataFrame:
    """Risk universe scan: numbers cleaned with the first-number rule,
    rows with a missing ticker or metric dropped."""
    raw = read_csv(spark, path, schemas.UNIVERSE_SCHEMA)
    df = raw.select("ticker", "sector", *[extract_number(c).alias(c) for c in ("sigma", "mdd", "beta")])
    return df.na.drop(how="any", subset=["ticker", "sigma", "mdd", "beta"])


def first_with_columns(spark: SparkSession, paths: list[str], required) -> str:
    """The first candidate path that exists and whose header has the
    required columns (metadata only)."""
    for p in paths:
        if exists(spark, p):
            cols = {c.lstrip("\ufeff") for c in spark.read.option("header", True).csv(p).columns}
            if set(required) <= cols:
                return p
    raise FileNotFoundError(f"no candidate has columns {sorted(required)}: {paths}")


def load_fundamentals(spark: SparkSession, path: str) -> DataFrame:
    """Optional CSV (empty typed frame when absent), upper-case key."""
    df = read_csv(spark, path, schemas.FUNDAMENTALS_SCHEMA)
    return df.withColumn("Ticker", F.upper("Ticker"))


def load_scores(spark: SparkSession, path: str) -> DataFrame:
    """Optional CSV of stored investor scores (empty typed frame when
    absent); a score that is no number is null."""
    df = read_csv(spark, path, schemas.SCORE_SCHEMA)
    return df.select("investor", "category", F.col("srisk").try_cast("double").alias("srisk"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """K7: JSON lines, non-ASCII kept as is."""
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


TICKER_CACHE_SCHEMA = T.StructType([T.StructField("fetched_at", T.TimestampNTZType()),
                                    T.StructField("tickers", T.ArrayType(T.StringType()))])


def save_ticker_cache(tickers: DataFrame, path: str, fetched_at: str, col: str = "ticker") -> None:
    """One JSON record {fetched_at, tickers[]}.  The list is a universe
    of symbols (bounded by the number of listed securities)."""
    rec = tickers.agg(F.array_sort(F.collect_set(F.col(col))).alias("tickers")).select(
        F.lit(fetched_at).cast("timestamp_ntz").alias("fetched_at"), "tickers")
    rec.coalesce(1).write.mode("overwrite").json(path)


def load_ticker_cache(spark: SparkSession, path: str, as_of: str, max_age_days: int = 85) -> DataFrame:
    """Cached tickers when the cache is younger than ``max_age_days``,
    else no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], "ticker string")
    c = spark.read.schema(TICKER_CACHE_SCHEMA).json(path)
    fresh = c.where(F.lit(as_of).cast("timestamp_ntz") - F.col("fetched_at") <= F.expr(f"INTERVAL {max_age_days} DAYS"))
    return fresh.select(F.explode("tickers").alias("ticker"))


def snapshot_then_overwrite(df: DataFrame, path: str, name: str = "current") -> VersionedStore:
    """K8 + K10 + K13: refuse an empty result; else write ``df`` as the new
    version of the table (created when missing).  The version before stays
    readable, and a job stopped at any point leaves it the current one."""
    store = VersionedStore(df.sparkSession, path)
    store.create(name, df.schema, [df.columns[0]])
    store.commit({name: df}, allow_empty=False)
    return store


def tickers_from_csv(spark: SparkSession, path: str, col: str = "Ticker") -> DataFrame:
    """Symbols of a CSV column, normalised, first occurrence kept in file
    order, error when none.  File order = (input file, row position)."""
    from riskfold.functions.text import symbol_norm
    df = spark.read.option("header", True).csv(path)
    if col not in df.columns:
        raise ValueError(f"{col} column not found in {path}")
    x = df.select(symbol_norm(col).alias("ticker"), F.input_file_name().alias("_f"),
                  F.monotonically_increasing_id().alias("_p")).where(F.col("ticker").isNotNull() & (F.col("ticker") != ""))
    from riskfold.operators.news import keep_first
    out = keep_first(x, "ticker", ["_f", "_p"])
    if out.isEmpty():
        raise ValueError(f"no tickers in {path}")
    return out
