"""News-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfold.functions import dates as D
from riskfold.functions import text as X
from riskfold.operators import html, news
from riskfold.plans import bindings as B
from riskfold.plans import sql_fragments as S
from riskfold.plans.catalog import register
from riskfold.sources.tables import read_table


def prepared(spark, sf):
    """R11 output with the source order kept for keep-first decisions."""
    return news.preprocess(B.raw_news(spark, sf), order="Doc Id")


def _with_lang(spark, sf):
    raw = B.raw_news(spark, sf)
    p = news.preprocess(raw, order="Doc Id")
    return p.join(raw.select(F.col("Doc Id").alias("src_order"), F.col("Lang").alias("lang")), "src_order")


@register("q_preprocess", sql=f"""
WITH {S.PREP}
SELECT id, headline, ticker, pubdate, summary FROM prep""")
def q_preprocess(spark, sf):
    """R11 (P4, P9, P10, F12, X1-X3, V1, P11): landed news -> article rows."""
    return news.preprocess(B.raw_news(spark, sf))


_STORE = f"""
WITH {S.PREP},
tgt AS (SELECT * FROM prep WHERE lang = 'en'
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY src_order) = 1),
bat AS (SELECT * FROM prep QUALIFY row_number() OVER (PARTITION BY id ORDER BY src_order) = 1)"""


def _store(spark, sf):
    p = _with_lang(spark, sf)
    empty = p.limit(0).drop("lang")
    target = news.upsert_ignore(empty, p.where(F.col("lang") == "en").drop("lang"))
    return target, p.drop("lang")


@register("q_upsert_ignore", sql=_STORE + """
SELECT id, headline, ticker, pubdate, summary FROM tgt
UNION ALL
SELECT id, headline, ticker, pubdate, summary FROM bat WHERE id NOT IN (SELECT id FROM tgt)""")
def q_upsert_ignore(spark, sf):
    """K3 + P12 + W9: insert-or-ignore of the whole batch into a store that
    already holds the English articles (first row per id wins)."""
    target, batch = _store(spark, sf)
    return news.upsert_ignore(target, batch).drop("src_order")


@register("q_upsert_overwrite", sql=_STORE + f""",
upd AS (SELECT id, headline, ticker, pubdate, '[rev] ' || summary AS summary, src_order FROM prep
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY src_order DESC) = 1),
{S.ARTICLES}
SELECT id, headline, ticker, pubdate, summary FROM tgt WHERE id NOT IN (SELECT id FROM upd)
UNION ALL
SELECT id, headline, ticker, pubdate, summary FROM arts
UNION ALL
SELECT id, headline, ticker, pubdate, summary FROM upd""")
def q_upsert_overwrite(spark, sf):
    """K4 + P12: insert-or-overwrite a revised batch of every language (last row
    per id wins) into a store that also holds articles of another feed, whose
    ids the batch does not know; the batch brings columns the store has not."""
    target, _ = _store(spark, sf)
    target = target.unionByName(B.articles(spark, sf).withColumn("src_order", F.lit(None).cast("long")))
    upd = _with_lang(spark, sf).withColumn("summary", F.concat(F.lit("[rev] "), F.col("summary")))
    return news.upsert_overwrite(target, upd, order="src_order").drop("src_order")


_DAY = "DATE '2024-12-31' - CAST(doc_id % 366 AS INTEGER)"


@register("q_date_columns", sql=f"""
SELECT doc_id, strftime({_DAY}, '%Y-%m-%d') AS pub_day, strftime({_DAY}, '%Y-%m-%d') || ' 06:30:00' AS update_time,
       CASE WHEN lang <> 'es' THEN strftime({_DAY}, '%Y-%m-%d') || ' 00:00:00' END AS fetched_at, source AS origin
FROM documents""")
def q_date_columns(spark, sf):
    """X1 + X2: dates of a whole year in five formats, and every further
    date-like column (by its name) cast; other columns stay as they are."""
    d = read_table(spark, sf, "documents").select("doc_id", "lang", "source")
    day = F.date_sub(F.lit("2024-12-31").cast("date"), F.pmod("doc_id", F.lit(366)).cast("int"))
    text = {0: F.date_format(day, "MMMM d, yyyy"), 1: F.date_format(day, "d-MMM-yy"), 2: F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"),
            3: F.date_format(day, "EEE, dd MMM yyyy HH:mm:ss '+0000'"), 4: F.date_format(day, "M/d/yyyy")}
    kind = F.pmod("doc_id", F.lit(5))
    pub = F.coalesce(*[F.when(kind == k, t) for k, t in text.items()])
    raw = d.select("doc_id", pub.alias("pub_text"), F.date_format(day, "yyyy-MM-dd 06:30:00").alias("update_time"),
                   F.when(F.col("lang") == "es", F.lit("not a date")).otherwise(F.date_format(day, "d MMM yyyy")).alias("fetched_at"),
                   F.col("source").alias("origin"))
    out = D.parse_date_columns(raw)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("doc_id", F.date_format(D.normalize_pubdate("pub_text"), "yyyy-MM-dd").alias("pub_day"), stamp("update_time"),
                      stamp("fetched_at"), "origin")


@register("q_retention", sql=f"""
WITH {S.ARTICLES}
SELECT id, pubdate FROM arts WHERE NOT (pubdate IS NOT NULL AND pubdate < TIMESTAMP '{B.AS_OF}' - INTERVAL 14 DAYS)""")
def q_retention(spark, sf):
    """P7 + K6: purge articles older than 14 days (undated kept) from the
    article table and, consistently, from its index."""
    a = B.articles(spark, sf)
    kept, purged = news.retention_split(a, B.AS_OF, 14)
    index = a.select("id", F.array(F.lit(0.0).cast("float")).alias("ivect"))
    arts, _idx = news.delete_keys([a, index], purged)
    return arts.select("id", "pubdate")


@register("q_recent_news", sql=f"""
WITH {S.ARTICLES}
SELECT ticker, id, headline, strftime(pubdate, '%Y-%m-%d') AS pubdate, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker
           ORDER BY coalesce(strftime(pubdate, '%Y-%m-%d %H:%M:%S'), id) DESC, id DESC) AS rank
  FROM arts WHERE summary IS NOT NULL AND length(trim(summary)) > 0)
WHERE rank <= 3""")
def q_recent_news(spark, sf):
    """W8 + P5 + T2 + S6: latest three summarised articles per ticker
    (undated rows sort by their id text)."""
    a = B.articles(spark, sf)
    w = news.Window.partitionBy("ticker").orderBy(news.sort_key_recent().desc(), F.col("id").desc())
    a = a.where(~X.is_blank("summary")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 3)
    return a.select("ticker", "id", "headline", F.date_format("pubdate", "yyyy-MM-dd").alias("pubdate"),
                    F.col("rank").cast("int").alias("rank"))


@register("q_index_candidates", sql=f"""
WITH {S.ARTICLES}
SELECT id, ticker FROM arts
WHERE summary IS NOT NULL AND length(trim(summary)) > 0
  AND (pubdate IS NULL OR pubdate >= TIMESTAMP '{B.AS_OF}' - INTERVAL 30 DAYS)""")
def q_index_candidates(spark, sf):
    """P5 + P6: articles eligible for the vector index."""
    return news.index_candidates(B.articles(spark, sf), B.AS_OF, 30).select("id", "ticker")


LIVE_DAYS = 2


@register("q_news_fallback", sql=f"""
WITH {S.ARTICLES}, {S.PREP},
live AS (SELECT ticker, headline, 'live' AS origin, k AS rank FROM (
           SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY src_order) AS k FROM prep
           WHERE pubdate >= TIMESTAMP '{B.AS_OF}' - INTERVAL {LIVE_DAYS} DAY AND pubdate <= TIMESTAMP '{B.AS_OF}'
             AND length(trim(headline)) > 0) WHERE k <= 3),
stored AS (SELECT ticker, headline, 'stored' AS origin, k AS rank FROM (
           SELECT *, row_number() OVER (PARTITION BY ticker
                ORDER BY coalesce(strftime(pubdate, '%Y-%m-%d %H:%M:%S'), id) DESC, id DESC) AS k
           FROM arts WHERE summary IS NOT NULL AND length(trim(summary)) > 0) WHERE k <= 3)
SELECT * FROM live
UNION ALL
SELECT * FROM stored WHERE ticker NOT IN (SELECT ticker FROM live)""")
def q_news_fallback(spark, sf):
    """Per ticker, the live items (landed news of every language published
    in the last LIVE_DAYS days) when there are any, else the stored articles."""
    landed = news.preprocess(B.raw_news(spark, sf), order="Doc Id")
    live = landed.where(F.col("pubdate").between(D.cutoff(B.AS_OF, LIVE_DAYS), F.lit(B.AS_OF).cast("timestamp_ntz")))
    return news.live_or_stored(live, B.articles(spark, sf), "src_order")


@register("q_preview", sql=f"""
WITH {S.ARTICLES}
SELECT id, ticker, substr(headline, 1, 60) AS headline, substr(summary, 1, 80) AS summary_head,
       strftime(pubdate, '%Y-%m-%d') AS pubdate, (SELECT count(*) FROM arts) AS n_rows
FROM arts ORDER BY coalesce(strftime(pubdate, '%Y-%m-%d %H:%M:%S'), id) DESC, id DESC LIMIT 10""")
def q_preview(spark, sf):
    """P26 + A18 + F7: the ten newest rows with prefix text columns and the row count."""
    a = B.articles(spark, sf)
    n = a.select(F.count("*")).scalar()
    top = a.orderBy(news.sort_key_recent().desc(), F.col("id").desc()).limit(10)
    return top.select("id", "ticker", F.substring("headline", 1, 60).alias("headline"),
                      F.substring("summary", 1, 80).alias("summary_head"),
                      F.date_format("pubdate", "yyyy-MM-dd").alias("pubdate"), n.alias("n_rows"))


@register("q_sample", sql=f"""
WITH {S.ARTICLES}
SELECT id, ticker, headline FROM arts WHERE upper(ticker) = upper('Src3') ORDER BY CAST(id AS BIGINT) LIMIT 5""")
def q_sample(spark, sf):
    """P19 + T7: case-insensitive ticker filter, first five rows by key."""
    a = B.articles(spark, sf).withColumn("_k", F.col("id").cast("bigint"))
    return news.sample_for_key(a, "ticker", "Src3", 5, "_k").select("id", "ticker", "headline")


def link_table(spark, sf):
    """Stored link table: one row per https page (ticker = host)."""
    p = read_table(spark, sf, "pages")
    return p.select(X.url_host("url").alias("ticker"), F.col("url").alias("link"),
                    F.col("page_id").alias("src_order")).where(F.col("link").startswith("https://"))


def link_candidates(spark, sf):
    p = read_table(spark, sf, "pages")
    return p.select(X.url_host("url").alias("ticker"), F.col("url").alias("link"), F.col("page_id").alias("src_order"))


def block_list(spark, sf):
    p = read_table(spark, sf, "pages")
    return (p.select(X.url_host("url").alias("ticker"), F.col("url").alias("link"))
            .where(F.col("ticker").startswith("m.")))


_LINKS = r"""
pg AS (SELECT page_id, url, NULLIF(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '') AS ticker FROM pages),
stored AS (SELECT ticker, url AS link FROM pg WHERE starts_with(url, 'https://')),
blocked AS (SELECT ticker, url AS link FROM pg WHERE starts_with(ticker, 'm.'))"""


@register("q_new_links", sql=f"""
WITH {_LINKS}
SELECT ticker, link FROM pg c (page_id, link, ticker)
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.ticker IS NOT DISTINCT FROM c.ticker AND s.link = c.link)
  AND NOT EXISTS (SELECT 1 FROM blocked b WHERE b.ticker IS NOT DISTINCT FROM c.ticker AND b.link = c.link)""")
def q_new_links(spark, sf):
    """J6 + P17: discovered links that are neither stored nor blocked."""
    c = link_candidates(spark, sf)
    out = news.new_links(c, link_table(spark, sf), block_list(spark, sf))
    return out.select("ticker", "link")


@register("q_partition_replace", sql=f"""
WITH {_LINKS},
fresh AS (SELECT ticker, url AS link FROM pg WHERE starts_with(url, 'http://'))
SELECT ticker, link, 'stored' AS origin FROM stored WHERE ticker NOT IN (SELECT ticker FROM fresh WHERE ticker IS NOT NULL)
UNION ALL SELECT ticker, link, 'fresh' FROM fresh""")
def q_partition_replace(spark, sf):
    """K2: every host crawled again (plain-http pages) replaces its stored rows."""
    stored = link_table(spark, sf).select("ticker", "link", F.lit("stored").alias("origin"))
    fresh = (link_candidates(spark, sf).where(F.col("link").startswith("http://"))
             .select("ticker", "link", F.lit("fresh").alias("origin")))
    return news.replace_keys(stored, fresh.where(F.col("ticker").isNotNull())).unionByName(
        fresh.where(F.col("ticker").isNull()))


@register("q_block_list", sql=f"""
WITH {_LINKS},
rej AS (SELECT ticker, url AS link FROM pg WHERE starts_with(url, 'http://') AND ticker IS NOT NULL)
SELECT DISTINCT ticker, link FROM (SELECT * FROM blocked UNION ALL SELECT * FROM rej)""")
def q_block_list(spark, sf):
    """K11 + U2 + W9: append rejected links (here: every plain-http page) to
    the block list, keeping the first row per (ticker, link)."""
    cur = block_list(spark, sf).withColumn("src_order", F.lit(0).cast("long"))
    todo = link_candidates(spark, sf).where(F.col("link").startswith("http://") & F.col("ticker").isNotNull())
    new = news.append_distinct(cur, todo.select("ticker", "link", "src_order"))
    return new.select("ticker", "link")


@register("q_seeded_sample", sql="""
SELECT CAST(doc_id AS VARCHAR) AS id, source AS ticker FROM documents
ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42'), CAST(doc_id AS VARCHAR) LIMIT 25""")
def q_seeded_sample(spark, sf):
    """A deterministic pseudo-random sample of 25 articles (md5 of id
    and seed)."""
    return news.seeded_sample(B.articles(spark, sf), "id", 25, seed=42).select("id", "ticker")
