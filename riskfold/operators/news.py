"""News tables: preprocess, ids, upserts, retention, recency, link tables
(J6, J9, J17, K2-K6, K11, P3-P9, P15-P19, P26, V1, W8, W9, R11, R12, R15).

Table maintenance is expressed as joins: insert-or-ignore is a left-anti
join of the batch against the target, overwrite is the target anti-joined
with the batch plus the batch, delete is an anti-join with a key table.
"Keep first" always uses an explicit order column (never an arbitrary
``dropDuplicates`` row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold import schemas
from riskfold.functions import dates as D
from riskfold.functions import text as X

ARTICLE_COLUMNS = [f.name for f in schemas.ARTICLE_SCHEMA.fields]

# Fixed values of the content filter.
PREMIUM_MARKER = "PREMIUM"
VIDEO_BYLINE = "Yahoo Finance Video"
BLOCKED_PUBLISHERS = ("Motley Fool", "Barchart", "The Wall Street Journal", "Zacks", "Benzinga", "Quartz")


def keep_first(df: DataFrame, keys, order, last: bool = False) -> DataFrame:
    """The first (``last=True``: the last) row per key set by an explicit
    order (the order columns should be unique within a key).

    An aggregation (``min_by`` / ``max_by`` of the whole row over the order
    struct), not a window: rows are pre-combined map-side, so a key holding
    a third of all rows never lands in one task as a whole."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    rest = [c for c in df.columns if c not in keys]
    ordc = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    pick = F.max_by if last else F.min_by
    agg = df.groupBy(*keys).agg(pick(F.struct(*[F.col(f"`{c}`") for c in rest]), ordc).alias("_row"))
    return agg.select(*keys, *[F.col("_row").getField(c).alias(c) for c in rest]).select(*df.columns)


def article_id(ticker: Column, key: Column, pub_text: Column) -> Column:
    """V1: sha1 hex of 'ticker|key|pubdate-text'."""
    return F.sha1(F.concat_ws("|", F.coalesce(ticker.cast("string"), F.lit("")), key, pub_text))


def preprocess(raw: DataFrame, order: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Snake names -> aliases -> primary URL -> required ticker and
    headline -> publish date normalisation -> date-like columns -> id ->
    conform to the article schema.  ``order`` (a source column, kept as
    ``src_order``) records the input order for keep-first decisions; further
    columns ``keep`` (by their snake names) are carried along."""
    df = schemas.apply_news_aliases(schemas.snake_columns(raw))
    urls = schemas.url_columns(df)
    df = df.withColumn("primary_url", X.first_non_blank(*urls) if urls else F.lit(None).cast("string"))
    df = df.where(F.col("ticker").isNotNull() & F.col("headline").isNotNull())
    if "pubdate" in df.columns:
        df = df.withColumn("pubdate", D.pubdate_timestamp("pubdate"))
    df = D.parse_date_columns(df, skip=("pubdate",))
    pub = D.pick_pub_column(df)
    # truthy fall-back: first non-empty of primary_url, link, url, href, headline
    chain = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in
             ("primary_url", "link", "url", "href", "headline") if c in df.columns]
    key = F.coalesce(*chain, F.lit(""))
    pub_text = D.pubdate_text(F.col(pub)) if pub else F.lit("")
    df = df.withColumn("id", article_id(F.col("ticker"), key, pub_text))
    fields = schemas.ARTICLE_SCHEMA.fields + [df.schema[c] for c in keep]
    if order is not None:
        df = df.withColumn("src_order", F.col(X.snake_name(order)).cast("long"))
        fields = fields + [T.StructField("src_order", T.LongType())]
    return schemas.conform(df, T.StructType(fields))


def upsert_ignore(target: DataFrame, batch: DataFrame, key: str = "id", order: str = "src_order") -> DataFrame:
    """K3: insert-or-ignore: the first batch row per key (in batch order) is
    inserted unless the key is already stored; stored rows never change."""
    first = keep_first(schemas.intersect_columns(batch, [*target.columns, order]), key, order)  # P12: what the table has
    first = schemas.intersect_columns(first.join(target.select(key), key, "left_anti"), target.columns)
    return target.unionByName(first, allowMissingColumns=True).select(*target.columns)


def upsert_overwrite(target: DataFrame, batch: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """K4: insert-or-overwrite: batch rows replace stored rows with the same
    key (the last batch row per key wins when ``order`` is given)."""
    b = batch
    if order is not None:
        b = keep_first(batch, key, order, last=True)
    b = schemas.intersect_columns(b, target.columns)
    return target.join(b.select(key), key, "left_anti").unionByName(b, allowMissingColumns=True).select(*target.columns)


def update_column(target: DataFrame, updates: DataFrame, col: str, key: str = "id") -> DataFrame:
    """K5: set one column by key (null update keeps the stored value)."""
    u = updates.select(key, F.col(col).alias("_new"))
    return (target.join(u, key, "left")
            .withColumn(col, F.coalesce(F.col("_new"), F.col(col))).drop("_new")
            .select(*target.columns))


def delete_keys(tables: list[DataFrame], keys: DataFrame, key: str = "id") -> list[DataFrame]:
    """K6: delete one key set from several tables consistently."""
    k = keys.select(key).distinct()
    return [t.join(k, key, "left_anti") for t in tables]


def retention_split(articles: DataFrame, as_of: str, days_keep: int) -> tuple[DataFrame, DataFrame]:
    """(kept, purged ids): rows older than as_of - days are purged,
    undated rows are kept."""
    cut = D.cutoff(as_of, days_keep)
    old = F.col("pubdate").isNotNull() & (F.col("pubdate") < cut)
    return articles.where(~old), articles.where(old).select("id")


def sort_key_recent(pubdate: str = "pubdate", key: str = "id") -> Column:
    """COALESCE(pubdate-text, id) — undated rows sort by their id text."""
    return F.coalesce(F.date_format(F.col(pubdate), "yyyy-MM-dd HH:mm:ss"), F.col(key))


def recent_per_ticker(articles: DataFrame, n: int = 3, ticker: str = "ticker") -> DataFrame:
    """W8 + P5 + T2: latest n summarised articles per ticker."""
    a = articles.where(~X.is_blank("summary"))
    w = Window.partitionBy(ticker).orderBy(sort_key_recent().desc(), F.col("id").desc())
    return a.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def live_or_stored(live: DataFrame, stored: DataFrame, order: str, n: int = 3, ticker: str = "ticker") -> DataFrame:
    """Per ticker the first ``n`` live items with a headline, in feed
    order; tickers without any get their latest ``n`` stored articles."""
    w = Window.partitionBy(ticker).orderBy(order)
    now = (live.where(~X.is_blank("headline")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
           .withColumn("origin", F.lit("live")))
    rest = recent_per_ticker(stored, n, ticker).join(now.select(ticker).distinct(), ticker, "left_anti").withColumn("origin", F.lit("stored"))
    columns = [ticker, "headline", "origin", "rank"]
    return now.select(*columns).unionByName(rest.select(*columns))


def index_candidates(articles: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """P5 + P6: summarised and (undated or recent) articles."""
    return articles.where(~X.is_blank("summary") &
                          (F.col("pubdate").isNull() | (F.col("pubdate") >= D.cutoff(as_of, days))))


def new_links(candidates: DataFrame, stored: DataFrame, blocked: DataFrame, prefix: str | None = None,
              order: str | None = None) -> DataFrame:
    """J6 + P17: (ticker, link) pairs neither stored nor blocked, optional
    URL prefix filter, one row per pair (the first by ``order``)."""
    c = candidates
    if prefix:
        c = c.where(F.col("link").startswith(prefix))
    c = c.join(stored.select("ticker", "link"), ["ticker", "link"], "left_anti")
    c = c.join(blocked.select("ticker", "link"), ["ticker", "link"], "left_anti")
    return c.dropDuplicates(["ticker", "link"]) if order is None else keep_first(c, ["ticker", "link"], order)


def skip_populated(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key the store does not hold yet."""
    return rows.join(stored.select(key), key, "left_anti")


def append_distinct(current: DataFrame, new: DataFrame, keys=("ticker", "link"), order: str = "src_order") -> DataFrame:
    """Union then keep the first row per key (current rows
    first, then new rows in their order)."""
    cur = current.withColumn("_src", F.lit(0))
    nw = new.withColumn("_src", F.lit(1))
    u = cur.unionByName(nw, allowMissingColumns=True)
    return keep_first(u, list(keys), ["_src", order]).drop("_src")


def replace_keys(stored: DataFrame, fresh: DataFrame, key: str = "ticker") -> DataFrame:
    """K2: rows of every key present in ``fresh`` are replaced by the fresh
    rows; other keys keep their stored rows."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def content_status(body: str = "body", byline: str = "byline", publisher: str = "publisher",
                   title: str = "title") -> Column:
    """P15 + P16 as one column: 'rejected' (premium marker as first body
    line, video-desk byline or blocked publisher), 'kept' (non-empty title
    and body) or 'dropped'."""
    bad = ((X.first_line(F.col(body)) == PREMIUM_MARKER)
           | F.coalesce(F.col(byline).contains(VIDEO_BYLINE), F.lit(False))
           | F.coalesce(F.exists(F.array(*[F.lit(p) for p in BLOCKED_PUBLISHERS]),
                                 lambda p: F.contains(F.coalesce(F.col(publisher), F.lit("")), p)), F.lit(False)))
    ok = ~X.is_blank(title) & ~X.is_blank(body)
    return F.when(bad, F.lit("rejected")).when(ok, F.lit("kept")).otherwise(F.lit("dropped"))


def content_filter(pages: DataFrame, **cols) -> tuple[DataFrame, DataFrame]:
    """P15 + P16: (kept, rejected) rows of one status projection."""
    s = pages.withColumn("_status", content_status(**cols))
    return s.where(F.col("_status") == "kept").drop("_status"), s.where(F.col("_status") == "rejected").drop("_status")


def drop_all_null(df: DataFrame, cols) -> DataFrame:
    """Drop rows where every listed column is null."""
    return df.na.drop(how="all", subset=list(cols))


def preview(articles: DataFrame, index: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """Newest rows with short text columns and vector byte length.  The texts
    are cut where they are read: whole ones travel to no join."""
    a = articles.select("id", "ticker", F.substring("headline", 1, 60).alias("headline"),
                        F.substring("summary", 1, 80).alias("summary_head"), "pubdate")
    if index is not None:
        a = a.join(index.select("id", (F.size("ivect") * 4).cast("long").alias("ivect_bytes")), "id")
    return a.orderBy(sort_key_recent().desc(), F.col("id").desc()).limit(limit)


def sample_for_key(df: DataFrame, key_col: str, key_value: str, n: int, order: str) -> DataFrame:
    """Case-insensitive key filter then the first n rows by ``order``."""
    return df.where(F.upper(F.col(key_col)) == F.upper(F.lit(key_value))).orderBy(order).limit(n)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Deterministic pseudo-random n rows (hash of key and seed)."""
    return df.orderBy(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)).limit(n)


def metadata_lines(**columns: str) -> Column:
    """``Label: value`` lines of the columns that have a value."""
    return F.array_join(F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(label.replace("_", " ") + ": "), F.col(c).cast("string")))
                                           for label, c in columns.items()]), lambda x: x.isNotNull()), "\n")


def best_texts(sources: list[DataFrame], order: str = "src_order") -> DataFrame:
    """One row per (headline, ticker) over ordered sources (headline, ticker,
    article, lines, ``order``): of the first source that knows the pair its
    first article, or its first row's metadata lines when none has one.  The
    sources are reduced before anything is joined to them."""
    pairs = None
    for rank, source in enumerate(sources):
        one = (source.groupBy("headline", "ticker")
               .agg(F.min_by("article", F.when(F.col("article").isNotNull(), F.col(order))).alias("article"), F.min_by("lines", order).alias("lines"))
               .withColumn("_rank", F.lit(rank)))
        pairs = one if pairs is None else pairs.unionByName(one)
    first = pairs.groupBy("headline", "ticker").agg(F.min_by(F.struct("article", "lines"), "_rank").alias("t"))
    return first.select("headline", "ticker", "t.article", F.when(F.col("t.article").isNull(), F.col("t.lines")).alias("lines"))
