"""Streaming queries: each lands its table as several files,
runs a Structured Streaming job over them to completion (availableNow,
LANDED_FILES micro-batches) and returns the table it maintains."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfold.functions import text as X
from riskfold.operators import corpus, maintenance, news
from riskfold.plans import bindings as B
from riskfold.plans import vector_plans
from riskfold.plans import sql_fragments as S
from riskfold.plans.catalog import register
from riskfold.sources.tables import read_table
from riskfold.sources.versioned import VersionedStore
from riskfold.streaming import jobs

LANDED_FILES = 4  # micro-batches; a large table lands as several files each
# Fixed parameters: freshness of cached quotes, and the smallest valid reading.
TTL_SHORT_SECONDS, TTL_LONG_SECONDS = 60, 900
MIN_VALUE = 1.0


def _landed(spark, sf, table, key, root):
    df = read_table(spark, sf, table)
    each = jobs.files_per_batch(df, LANDED_FILES)
    return jobs.file_stream(spark, jobs.land(df, key, LANDED_FILES * each, f"{root}/landed"), df.schema, each)


@register("q_stream_dedup", sql="""
SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, min(event_id) AS event_id
FROM events GROUP BY 1, 2""")
def q_stream_dedup(spark, sf):
    """Only-new (user, item) keys across micro-batches (first event wins)."""
    root = jobs.stream_root(spark, "dedup")
    ev = _landed(spark, sf, "events", "event_id", root).select(
        "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), "event_id")
    return jobs.dedup_stream(spark, ev, ["user_id", "k"], "event_id", root).read()


@register("q_stream_latest", sql=f"""
WITH l AS (SELECT user_id, arg_max(value, ts) AS latest_value, max(ts) AS latest_ts FROM events GROUP BY user_id)
SELECT user_id, latest_value, strftime(latest_ts, '%Y-%m-%d %H:%M:%S') AS latest_ts,
       (SELECT max(ts) FROM events) - latest_ts <= INTERVAL {TTL_SHORT_SECONDS} SECONDS AS fresh_60s,
       (SELECT max(ts) FROM events) - latest_ts <= INTERVAL {TTL_LONG_SECONDS} SECONDS AS fresh_15m
FROM l""")
def q_stream_latest(spark, sf):
    """Latest value per user from a stateful streaming aggregation, with
    its freshness against the newest event."""
    root = jobs.stream_root(spark, "latest")
    t = jobs.latest_value_stream(spark, _landed(spark, sf, "events", "event_id", root), "user_id", "ts", "value", root)
    now = t.select(F.max("latest_ts")).scalar()

    def fresh(seconds):
        return F.col("latest_ts") >= now - F.expr(f"INTERVAL {seconds} SECONDS")

    return t.select("user_id", "latest_value", fresh(TTL_SHORT_SECONDS).alias("fresh_60s"),
                    fresh(TTL_LONG_SECONDS).alias("fresh_15m"),
                    F.date_format("latest_ts", "yyyy-MM-dd HH:mm:ss").alias("latest_ts"))


@register("q_stream_retention", sql=f"""
WITH ok AS (SELECT * FROM events WHERE value >= {MIN_VALUE})
SELECT event_id, user_id, event_type, 'kept' AS status FROM ok
WHERE ts >= (SELECT max(ts) FROM ok) - INTERVAL 7 DAYS
UNION ALL
SELECT event_id, user_id, event_type, 'dead' FROM events WHERE value IS NULL OR value < {MIN_VALUE}""")
def q_stream_retention(spark, sf):
    """G5 + G2: seven-day retention on the streamed table; readings that are
    missing or too small go to the dead letters."""
    root = jobs.stream_root(spark, "retention")
    kept, dead = jobs.retention_stream(spark, _landed(spark, sf, "events", "event_id", root), "ts", 7, root,
                                       valid=F.col("value") >= MIN_VALUE)
    cols = ["event_id", "user_id", "event_type"]
    return kept.select(*cols, F.lit("kept").alias("status")).unionByName(dead.select(*cols, F.lit("dead").alias("status")))


@register("q_stream_pipeline", sql=f"""
WITH {S.PREP}
SELECT id, ticker, headline FROM prep QUALIFY row_number() OVER (PARTITION BY id ORDER BY src_order) = 1""")
def q_stream_pipeline(spark, sf):
    """G1 + G6: landed news stream -> preprocess -> insert-or-ignore, one
    appended delta per cycle."""
    root = jobs.stream_root(spark, "news")
    docs = _landed(spark, sf, "documents", "doc_id", root)
    return jobs.news_pipeline_stream(spark, B.raw_news_from(docs), root).read().select("id", "ticker", "headline")


def news_cycle(store, documents, batch):
    """One cycle over landed documents; those in Spanish come without a summary,
    it is drawn from the whole article."""
    raw = B.raw_news_from(documents)
    given = F.when(F.col("Lang") != "es", F.col("Summary"))
    # drawn where the article is read: a sentence is sent to the joins, not the article
    text = raw.withColumn("Drawn", F.when(X.is_blank(given), corpus.extractive_summary(F.col("Summary")))).withColumn("Summary", given)
    drawn = news.preprocess(text, order="Doc Id", keep=("drawn",)).where(X.is_blank("summary")).select("id", "src_order", "drawn")
    raw = raw.withColumn("Summary", given)

    def summarise(blank):
        return blank.select("id").join(drawn, "id").groupBy("id").agg(F.min_by("drawn", "src_order").alias("summary"))

    maintenance.news_cycle(store, raw, batch, B.AS_OF, vector_plans.encode_articles, summarise, "Doc Id", tile_size=512)


@register("q_stream_cycle")
def q_stream_cycle(spark, sf):
    """G1 + R16: landed news stream, every micro-batch one whole cycle
    (preprocess, insert, summaries, retention, near-duplicates, index, dead
    letters) committed as one unit; the three tables after the last one."""
    root = jobs.stream_root(spark, "cycle")
    store = VersionedStore(spark, f"{root}/tables")
    maintenance.create_tables(store)
    docs = _landed(spark, sf, "documents", "doc_id", root)
    jobs.news_cycle_stream(spark, docs, store, lambda df, batch: news_cycle(store, df, batch), root)
    index = store.read("index").select("id", F.octet_length("ivect").cast("long").alias("ivect_bytes"))
    kept = store.read("articles").join(index, "id", "left")
    cols = ["id", "ticker", "headline", "ivect_bytes"]
    dead = store.read("dead").select(F.col("src_order").cast("string").alias("id"), "ticker", "headline", F.lit(None).cast("long").alias("ivect_bytes"))
    return kept.select(*cols, F.lit("kept").alias("status")).unionByName(dead.select(*cols, F.lit("dead").alias("status")))
