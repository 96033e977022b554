"""Maintenance of the article, index, link and block-list tables (K2, K4, K6,
K11, V9, R12, R13, R15) in a ``VersionedStore``: every step changes all the
tables it touches in one commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold import schemas
from riskfold.operators import news, vectors
from riskfold.session import broadcast_if_small, cut_lineage
from riskfold.sources.versioned import VersionedStore

INDEX_TABLE = T.StructType([T.StructField("id", T.StringType()), T.StructField("ivect", T.BinaryType())])
# a rejected row as it landed, its date unread
DEAD_TABLE = T.StructType([*[T.StructField(c, T.StringType()) for c in schemas.ARTICLE_SCHEMA.names if c != "id"],
                           T.StructField("src_order", T.LongType())])
REJECT_SCHEMA = T.StructType([*schemas.BLOCK_SCHEMA.fields, T.StructField("src_order", T.LongType())])


def create_tables(store: VersionedStore, buckets: int = 0) -> None:
    """The article and index tables by their key ``id``."""
    store.create("articles", schemas.ARTICLE_SCHEMA, ["id"], buckets)
    store.create("index", INDEX_TABLE, ["id"], buckets)
    store.create("dead", DEAD_TABLE, ["src_order"])


def delete_ids(store: VersionedStore, ids: DataFrame) -> None:
    """K6: delete the ids from articles and index in one commit.  Few ids are
    sent to the rows; the rows do not move."""
    names = ("articles", "index")
    ids = broadcast_if_small(ids.select("id").distinct())
    store.commit(dict(zip(names, news.delete_keys([store.read(n) for n in names], ids))))


def cleanup(store: VersionedStore, as_of: str, days_keep: int, threshold: float, tile_size: int = 2048,
            encode: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Retention, then near-duplicate removal, each from both tables.
    ``encode`` gives (id, vec) of articles; without it the articles have a
    column ``vec``.  Returns the purged ids and the removed (id, anchor)."""
    _, purged = news.retention_split(store.read("articles"), as_of, days_keep)
    purged = cut_lineage(purged)
    delete_ids(store, purged)
    once = None if encode is None else lambda arts: cut_lineage(encode(arts).select("id", "vec"))
    gone = cut_lineage(vectors.dedupe_similar(_rated(store.read("articles"), once), threshold, tile_size=tile_size))
    delete_ids(store, gone)
    return purged, gone


def _rated(arts: DataFrame, encode: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """id, ticker, vec and quality of articles: all that clustering needs of them,
    so their texts are not sent to a join."""
    rows = arts.withColumn("ticker", F.coalesce("ticker", F.lit("UNK"))).withColumn("quality", vectors.quality())
    if encode is None:
        return rows.select("id", "ticker", "vec", "quality")
    return rows.select("id", "ticker", "quality").join(encode(arts).select("id", "vec"), "id")


def refresh_index(store: VersionedStore, encode: Callable[[DataFrame], DataFrame], as_of: str, days: int) -> None:
    """V9: insert-or-overwrite the vectors of the recent, summarised articles
    into the index; entries of other articles stay as they are."""
    fresh = cut_lineage(vectors.stored_index(encode(news.index_candidates(store.read("articles"), as_of, days)), as_of))
    store.commit({"index": news.upsert_overwrite(store.read("index"), fresh)})


def news_cycle(store: VersionedStore, raw: DataFrame, batch: str, as_of: str, encode: Callable[[DataFrame], DataFrame],
               summarise: Callable[[DataFrame], DataFrame], order: str, days_keep: int = 14, threshold: float = 0.9,
               index_days: int = 30, tile_size: int = 2048) -> None:
    """G1 + R16: one cycle over landed news, committed as one unit.

    preprocess (R11) -> insert-or-ignore (K3) -> summaries of new articles that
    have none (R10: ``summarise`` gives (id, summary) of them) -> retention and
    near-duplicate removal (R12) -> index upsert (V9) and consistent delete
    (K6).  Landed rows without ticker or headline become dead letters.
    ``encode`` gives (id, ticker, pubdate, vec) of articles."""
    if store.committed(batch, "cycle"):
        return
    prep = news.preprocess(raw, order=order)
    stored = store.read("articles")
    empty = F.trim(F.coalesce("summary", F.lit(""))) == ""
    # read twice: among rows of one place in the feed ``empty`` decides which both see
    new = news.keep_first(prep, "id", ["src_order", empty]).drop("src_order").join(stored.select("id"), "id", "left_anti")
    new = cut_lineage(news.update_column(new, summarise(new.where(empty)), "summary"))
    live, _ = news.retention_split(stored.unionByName(new.select(stored.columns)), as_of, days_keep)
    vectors_of = cut_lineage(encode(live))
    gone = cut_lineage(vectors.dedupe_similar(_rated(live, lambda _: vectors_of), threshold, tile_size=tile_size))
    kept = live.join(broadcast_if_small(gone.select("id")), "id", "left_anti")
    fresh = vectors_of.join(news.index_candidates(kept, as_of, index_days).select("id"), "id", "left_semi")
    fresh = cut_lineage(vectors.stored_index(fresh, as_of))
    index = news.upsert_overwrite(store.read("index").join(kept.select("id"), "id", "left_semi"), fresh)
    named = schemas.apply_news_aliases(schemas.snake_columns(raw))
    dead = named.where(F.col("ticker").isNull() | F.col("headline").isNull())
    dead = schemas.conform(dead.withColumn("src_order", F.col(schemas.snake_name(order)).cast("long")), DEAD_TABLE)
    store.commit({"articles": kept, "index": index, "dead": store.read("dead").unionByName(dead)}, batch=batch, stream="cycle")


def create_link_tables(store: VersionedStore) -> None:
    """The link table and the block list by (ticker, link)."""
    store.create("links", schemas.LINK_SCHEMA, ["ticker", "link"])
    store.create("blocked", REJECT_SCHEMA, ["ticker", "link"])


def refresh_links(store: VersionedStore, candidates: DataFrame, batch: str) -> None:
    """One refresh of the link table over all tickers of ``candidates``
    (ticker, link, headline, article, byline, publisher, src_order).

    Stored rows without headline and article go (P3); links that are neither
    stored nor blocked (J6) pass the content filter (P15, P16); each refreshed
    ticker's rows are replaced by what is left of them and its new ones (K2),
    rejected links are appended to the block list (K11).  Both tables change in
    one commit, once per ``batch``."""
    if store.committed(batch, "links"):
        return
    links = store.read("links")
    cleaned = news.drop_all_null(links, ["headline", "article"])
    fresh = news.new_links(candidates, cleaned, store.read("blocked"), order="src_order")
    kept, rejected = (cut_lineage(part) for part in news.content_filter(fresh, body="article", title="headline"))
    refreshed = cleaned.unionByName(schemas.conform(kept, schemas.LINK_SCHEMA))
    blocked = news.append_distinct(store.read("blocked"), rejected.select("ticker", "link", "src_order"))
    store.commit({"links": refreshed, "blocked": blocked}, batch=batch, stream="links")
