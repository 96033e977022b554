"""Vector queries and the cleanup pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold.operators import maintenance, news, vector_index, vectors
from riskfold.plans import bindings as B
from riskfold.plans import sql_fragments as S
from riskfold.plans.catalog import register
from riskfold.session import checkpoint_dir
from riskfold.sources.tables import read_table
from riskfold.sources.versioned import VersionedStore

SIM_THRESHOLD = 0.3   # the test vectors never reach the reference's 0.9
TOP_K = 5


def items(spark, sf):
    """Vectors with their article text (documents joined on id)."""
    v = B.vectors(spark, sf)
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return v.join(d, "id", "left").select("id", "ticker", "vec", B.headline_of("text").alias("headline"),
                                          F.col("text").alias("summary"))


def rated(spark, sf):
    """Vectors with the quality of their article: its texts are measured where they
    are read and do not travel to the join."""
    d = read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), B.headline_of("text").alias("headline"), F.col("text").alias("summary"))
    return B.vectors(spark, sf).join(d.select("id", vectors.quality().alias("quality")), "id", "left")


_V = """v AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS ticker, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"""


@register("q_dup_pairs", sql=f"""
WITH {_V}
SELECT a.ticker AS "group", a.id AS a, b.id AS b, round(list_dot_product(a.vec, b.vec), 6) AS sim
FROM v a JOIN v b ON a.ticker = b.ticker AND a.id < b.id
WHERE list_dot_product(a.vec, b.vec) >= {SIM_THRESHOLD}""")
def q_dup_pairs(spark, sf):
    """J12 + V7: exact similar pairs inside each ticker (cells, bounds, tiles)."""
    p = vector_index.similar_pairs(B.vectors(spark, sf), SIM_THRESHOLD, tile_size=128)
    return p.select("group", "a", "b", F.round("sim", 6).alias("sim"))


# Greedy clusters one row after the other: a row is an anchor if no earlier similar
# row of its ticker is one; every other row joins its earliest anchor.  ``rows_`` has
# id, ticker, vec, headline, summary.
_GREEDY = f"""
ord AS (SELECT ticker, id, vec, coalesce(length(summary), 0) + 0.5 * coalesce(length(headline), 0) AS quality,
               row_number() OVER (PARTITION BY ticker ORDER BY id) AS p FROM rows_),
edge AS (SELECT a.ticker, a.p AS pa, b.p AS pb FROM ord a JOIN ord b ON a.ticker = b.ticker AND a.p < b.p
         WHERE list_dot_product(a.vec, b.vec) >= {SIM_THRESHOLD}),
earlier AS (SELECT ticker, pb AS p, list(pa ORDER BY pa) AS near FROM edge GROUP BY 1, 2),
scan(ticker, p, anchors) AS (
  SELECT DISTINCT ticker, CAST(1 AS BIGINT), [CAST(1 AS BIGINT)] FROM ord
  UNION ALL
  SELECT s.ticker, s.p + 1, CASE WHEN e.near IS NULL OR NOT list_has_any(e.near, s.anchors) THEN list_append(s.anchors, s.p + 1)
                                 ELSE s.anchors END
  FROM scan s JOIN ord o ON o.ticker = s.ticker AND o.p = s.p + 1 LEFT JOIN earlier e ON e.ticker = o.ticker AND e.p = o.p),
anch AS (SELECT ticker, unnest(a) AS p FROM (SELECT ticker, arg_max(anchors, p) AS a FROM scan GROUP BY 1)),
member AS (SELECT ticker, p, p AS anchor FROM anch
           UNION ALL SELECT e.ticker, e.pb, min(e.pa) FROM edge e JOIN anch a ON a.ticker = e.ticker AND a.p = e.pa
           WHERE NOT EXISTS (SELECT 1 FROM anch x WHERE x.ticker = e.ticker AND x.p = e.pb) GROUP BY 1, 2),
full_ AS (SELECT m.ticker, m.anchor, o.id, row_number() OVER (PARTITION BY m.ticker, m.anchor ORDER BY o.quality DESC, o.p) AS r
          FROM member m JOIN ord o ON o.ticker = m.ticker AND o.p = m.p),
gone AS (SELECT f.id, o.id AS anchor FROM full_ f JOIN ord o ON o.ticker = f.ticker AND o.p = f.anchor WHERE f.r > 1)"""

_ITEMS = r"""
items AS (SELECT v.id, v.ticker, v.vec, trim(regexp_extract(d.text, '^[^\n.!?]*[.!?]?', 0)) AS headline, d.text AS summary
          FROM v LEFT JOIN documents d ON d.doc_id = v.id)"""


@register("q_dedupe_similar", sql=f"""
WITH RECURSIVE {_V}, {_ITEMS}, rows_ AS (SELECT * FROM items), {_GREEDY}
SELECT id, anchor FROM gone""")
def q_dedupe_similar(spark, sf):
    """V11 + A22 + A23: ids removed by greedy near-duplicate clustering."""
    return vectors.dedupe_similar(rated(spark, sf), SIM_THRESHOLD, tile_size=128)


def centroid_queries(spark, sf):
    """Query batch: every ticker's centroid, once unrestricted and once
    restricted to its own ticker."""
    v = B.vectors(spark, sf)
    ex = v.select("ticker", F.posexplode("vec").alias("i", "x"))
    m = ex.groupBy("ticker", "i").agg(F.avg("x").alias("m"))
    c = m.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("e"))
    c = c.select("ticker", F.transform("e", lambda s: s["m"]).alias("c"))
    n = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x))
    c = c.select("ticker", F.transform("c", lambda x: x / (n + 1e-8)).alias("qvec"))
    allq = c.select(F.concat("ticker", F.lit("/all")).alias("qid"), "qvec", F.lit(None).cast("string").alias("qticker"))
    own = c.select(F.concat("ticker", F.lit("/own")).alias("qid"), "qvec", F.col("ticker").alias("qticker"))
    return allq.unionByName(own)


@register("q_topk_search", sql=f"""
WITH {_V},
ex AS (SELECT ticker, i, x FROM (SELECT ticker, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM v)),
m AS (SELECT ticker, i, avg(x) AS m FROM ex GROUP BY 1, 2),
c AS (SELECT ticker, list(m ORDER BY i) AS c FROM m GROUP BY 1),
cn AS (SELECT ticker, list_transform(c, lambda x: x / (sqrt(list_dot_product(c, c)) + 1e-8)) AS q FROM c),
qs AS (SELECT ticker || '/all' AS qid, q, NULL AS qticker FROM cn
       UNION ALL SELECT ticker || '/own', q, ticker FROM cn),
sc AS (SELECT qs.qid, v.id, list_dot_product(v.vec, qs.q) / (sqrt(list_dot_product(v.vec, v.vec)) + 1e-8) AS score
       FROM qs JOIN v ON qs.qticker IS NULL OR v.ticker = qs.qticker),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc)
SELECT r.qid, CAST(r.rank AS INTEGER) AS rank, r.id, round(r.score, 6) AS score,
       trim(regexp_extract(d.text, '^[^\\n.!?]*[.!?]?', 0)) AS headline
FROM r LEFT JOIN documents d ON d.doc_id = r.id WHERE r.rank <= {TOP_K}""")
def q_topk_search(spark, sf):
    """V10 + J13 + J2 + P8 + T6: top-5 per query of a query batch, joined
    with article metadata."""
    hits = vector_index.scan(B.vectors(spark, sf), centroid_queries(spark, sf), TOP_K)
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), B.headline_of("text").alias("headline"))
    return hits.join(d, "id", "left").select("qid", F.col("rank").cast("int").alias("rank"), "id",
                                             F.round("score", 6).alias("score"), "headline")


@register("q_hash_encode", sql=f"""
WITH {S.ARTICLES},
t AS (SELECT id, unnest(string_split_regex(lower(coalesce(NULLIF(trim(summary), ''), trim(headline), '')),
                                           '[^\\p{{L}}\\p{{N}}]+')) AS tok FROM arts),
b AS (SELECT id, CAST(CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % 384 AS INTEGER) AS bucket, count(*) AS n
      FROM t WHERE tok <> '' GROUP BY 1, 2),
s AS (SELECT id, sum(n) AS n_tokens, count(*) AS n_buckets, sqrt(sum(n * n)) AS norm FROM b GROUP BY 1)
SELECT s.id, s.n_tokens, CAST(s.n_buckets AS INTEGER) AS n_buckets,
       round(sum(CAST(CAST(b.n / s.norm AS FLOAT) AS DOUBLE) * (b.bucket + 1)), 4) AS checksum,
       round(sum(CAST(CAST(b.n / s.norm AS FLOAT) AS DOUBLE) * CAST(CAST(b.n / s.norm AS FLOAT) AS DOUBLE)), 4) AS norm2
FROM s JOIN b USING (id) GROUP BY s.id, s.n_tokens, s.n_buckets""")
def q_hash_encode(spark, sf):
    """V2 + V12: default token-hash encoder over whole article texts."""
    a = B.articles(spark, sf).select("id", vectors.embed_text().alias("text"))
    e = vectors.hash_encode(a, "text", "id")
    idx = F.sequence(F.lit(1), F.lit(vectors.DIM_TEXT))
    chk = F.aggregate(F.zip_with("vec", idx, lambda x, i: x.cast("double") * i), F.lit(0.0), lambda a, x: a + x)
    n2 = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return e.select("id", "n_tokens", F.col("n_buckets").cast("int").alias("n_buckets"),
                    F.round(chk, 4).alias("checksum"), F.round(n2, 4).alias("norm2"))


# The encoder, the ticker vectors and the sign projection in SQL: signs are the bits
# of md5('<label>:<block>'), the first bit of a digit being its highest.
_BITS = """
digits AS (SELECT CAST(range AS INTEGER) AS d FROM range(32)), bits AS (SELECT CAST(range AS INTEGER) AS b FROM range(4)),
proj AS (SELECT CAST(r.range AS INTEGER) AS r, k.range * 128 + d * 4 + b AS j,
                (((strpos('0123456789abcdef', substr(md5('projection:20241027:' || r.range || ':' || k.range), d + 1, 1)) - 1) >> (3 - b)) & 1) * 2.0 - 1.0 AS sign
         FROM range(448) r, range(2) k, digits, bits),
tick AS (SELECT t, 384 + d * 4 + b AS r,
                (((strpos('0123456789abcdef', substr(md5('ticker:' || t || ':0'), d + 1, 1)) - 1) >> (3 - b)) & 1) * 2.0 - 1.0 AS sign
         FROM (SELECT DISTINCT coalesce(ticker, 'UNK') AS t FROM arts), digits, bits WHERE d < 8)"""


def _encoded(name, source, text):
    """CTEs ``<name>_vec``: id, r (0 .. 383), x of the encoded ``text`` of ``source``."""
    return f"""
{name}_t AS (SELECT id, unnest(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+')) AS tok FROM {source}),
{name}_b AS (SELECT id, CAST(CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % 384 AS INTEGER) AS r, count(*) AS n FROM {name}_t WHERE tok <> '' GROUP BY 1, 2),
{name}_vec AS (SELECT id, r, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS FLOAT) AS x FROM {name}_b)"""


def _projected(name, cat):
    """CTEs ``<name>_iv``: id, j (0 .. 255), y of the projected unit rows of ``cat`` (id, r, x)."""
    return f"""
{name}_y AS (SELECT c.id, p.j, sum(CAST(c.x AS DOUBLE) * p.sign / 16) AS y FROM {cat} c JOIN proj p ON p.r = c.r GROUP BY 1, 2),
{name}_iv AS (SELECT id, j, CAST(y / (sqrt(sum(y * y) OVER (PARTITION BY id)) + 1e-8) AS FLOAT) AS y FROM {name}_y)"""


_JOINED = "coalesce(NULLIF(concat_ws(' ', NULLIF(trim(summary), ''), NULLIF(trim(headline), '')), ''), '')"
_CANDIDATES = """
cand AS (SELECT * FROM arts WHERE trim(coalesce(summary, '')) <> ''
         AND (pubdate IS NULL OR pubdate >= TIMESTAMP '2024-03-02 00:00:00' - INTERVAL 30 DAYS))"""
_INDEX_SQL = f"""
{S.ARTICLES}, {_CANDIDATES}, {_BITS}, {_encoded('a', 'cand', _JOINED)},
rec AS (SELECT id, CASE WHEN pubdate IS NULL THEN 0.5::DOUBLE
        ELSE exp(-0.25::DOUBLE * greatest(0.0::DOUBLE, date_diff('second', pubdate, TIMESTAMP '2024-03-02 00:00:00') / 86400.0::DOUBLE)) END AS x FROM cand),
cat AS (SELECT id, r, CAST(CAST(x AS DOUBLE) * 0.8::DOUBLE AS FLOAT) AS x FROM a_vec
        UNION ALL SELECT c.id, k.r, CAST(CAST(CAST(k.sign / sqrt(32.0::DOUBLE) AS FLOAT) AS DOUBLE) * 0.1::DOUBLE AS FLOAT)
                  FROM cand c JOIN tick k ON k.t = coalesce(c.ticker, 'UNK')
        UNION ALL SELECT id, 416 + z.range, CAST(CAST(CAST(x / (abs(x) * sqrt(32.0::DOUBLE) + 1e-8::DOUBLE) AS FLOAT) AS DOUBLE) * 0.1::DOUBLE AS FLOAT)
                  FROM rec, range(32) z), {_projected('a', 'cat')}"""


def encode_articles(arts):
    """The articles' joined texts in the index' text space."""
    text = arts.select("id", "ticker", "pubdate", vectors.embed_text(joined=True).alias("text"))
    return vectors.hash_encode(text, "text", "id", keep=("ticker", "pubdate"))


@register("q_index_build", sql=f"""
WITH {_INDEX_SQL}
SELECT id, CAST(256 AS INTEGER) AS dims, round(sqrt(sum(CAST(y AS DOUBLE) * CAST(y AS DOUBLE))), 4) AS norm, CAST(1024 AS BIGINT) AS ivect_bytes,
       true AS round_trip, round(sum(CAST(y AS DOUBLE) * (j + 1)), 3) AS checksum
FROM a_iv GROUP BY id""")
def q_index_build(spark, sf):
    """V2-V6 + V8 + V9: integrated 256-d unit vectors of the index candidates,
    as the bytes that are stored."""
    arts = news.index_candidates(B.articles(spark, sf), B.AS_OF, 30)
    idx = vectors.build_index(encode_articles(arts), B.AS_OF)
    idx = idx.withColumn("data", vectors.vector_to_bytes(F.col("ivect"))).withColumn("back", vectors.bytes_to_vector(F.col("data")))
    n = F.sqrt(F.aggregate("ivect", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    place = F.sequence(F.lit(1), F.lit(vectors.DIM_TOTAL))
    check = F.aggregate(F.zip_with("back", place, lambda x, i: x.cast("double") * i), F.lit(0.0), lambda a, x: a + x)
    return idx.select("id", F.size("ivect").alias("dims"), F.round(n, 4).alias("norm"), F.octet_length("data").cast("long").alias("ivect_bytes"),
                      (F.col("back") == F.col("ivect")).alias("round_trip"), F.round(check, 3).alias("checksum"))


@register("q_text_search", sql=f"""
WITH {_INDEX_SQL},
asked AS (SELECT id, headline, ticker FROM arts WHERE CAST(id AS BIGINT) % 100 = 0), {_encoded('q', 'asked', "coalesce(headline, '')")},
q_cat AS (SELECT id, r, CAST(CAST(x AS DOUBLE) * 0.8::DOUBLE AS FLOAT) AS x FROM q_vec), {_projected('q', 'q_cat')},
qs AS (SELECT a.id, a.ticker, l.y FROM asked a JOIN (SELECT id, list(CAST(y AS DOUBLE) ORDER BY j) AS y FROM q_iv GROUP BY 1) l USING (id)),
both_ AS (SELECT id || '/all' AS qid, y, CAST(NULL AS VARCHAR) AS only FROM qs UNION ALL SELECT id || '/own', y, ticker FROM qs),
ix AS (SELECT c.id, c.ticker, l.y FROM cand c JOIN (SELECT id, list(CAST(y AS DOUBLE) ORDER BY j) AS y FROM a_iv GROUP BY 1) l USING (id)),
sc AS (SELECT b.qid, ix.id, round(list_dot_product(ix.y, b.y) / (sqrt(list_dot_product(ix.y, ix.y)) + 1e-8::DOUBLE), 6) AS score
       FROM both_ b JOIN ix ON b.only IS NULL OR ix.ticker = b.only),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc)
SELECT rk.qid, CAST(rk.rank AS INTEGER) AS rank, rk.id, rk.score, a.ticker, a.headline, a.pubdate
FROM rk JOIN arts a ON a.id = rk.id WHERE rk.rank <= {TOP_K}""")
def q_text_search(spark, sf):
    """V10 + J13 + J2 + P8 + T6: text queries (the headline of every article
    whose id is divisible by 100), each over all tickers and over its own one:
    text -> encode -> ticker / time parts zero -> project -> search of the stored
    index of all candidates, joined with the article's columns."""
    arts = B.articles(spark, sf)
    encoded = encode_articles(news.index_candidates(arts, B.AS_OF, 30))
    index = vector_index.build(vectors.build_index(encoded, B.AS_OF))
    asked = arts.where(F.col("id").cast("long") % 100 == 0).select(
        F.col("id").alias("qid"), F.coalesce("headline", F.lit("")).alias("text"), F.col("ticker").alias("qticker"))
    q = vectors.query_vectors(vectors.hash_encode(asked, "text", "qid", keep=("qticker",)), keep=("qticker",))
    both = (q.withColumn("scope", F.explode(F.array(F.lit("all"), F.lit("own"))))
            .select(F.concat_ws("/", "qid", "scope").alias("qid"), "qvec", F.when(F.col("scope") == "own", F.col("qticker")).alias("qticker"))
            # an article without a ticker has no scope of its own
            .where("qticker is not null or qid like '%/all'"))
    hits = vector_index.search(index, both, TOP_K)
    meta = arts.select("id", "ticker", "headline", "pubdate")
    return hits.join(meta, "id").select("qid", F.col("rank").cast("int").alias("rank"), "id", "score", "ticker", "headline", "pubdate")


def _states(rows, purged, gone, index):
    """Every id of ``rows``: kept, expired or duplicate (then with the anchor of
    its cluster), and the bytes that the index table holds for it."""
    marked = (rows.select("id").join(purged.select("id").withColumn("_old", F.lit(True)), "id", "left")
              .join(gone.select("id", "anchor"), "id", "left")
              .join(index.select("id", F.octet_length("ivect").cast("long").alias("ivect_bytes")), "id", "left"))
    state = F.when(F.col("_old"), "expired").when(F.col("anchor").isNotNull(), "duplicate").otherwise("kept")
    return marked.withColumn("state", state).select(
        F.col("id").cast("string").alias("id"), "state", F.col("anchor").cast("string").alias("anchor"), "ivect_bytes")


def _new_store(spark):
    return VersionedStore(spark, f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")


def _cleanup(spark, sf):
    """The article and index tables before and after the cleanup."""
    store = _new_store(spark)
    it = items(spark, sf).withColumn("pubdate", B.pubdate_of("id"))
    store.create("articles", it.schema, ["id"])
    store.create("index", T.StructType([it.schema["id"], T.StructField("ivect", T.BinaryType())]), ["id"])
    store.commit({"articles": it, "index": it.select("id", vectors.vector_to_bytes(F.col("vec")).alias("ivect"))})
    return store, *maintenance.cleanup(store, B.AS_OF, 14, SIM_THRESHOLD, tile_size=128)


@register("q_cleanup", sql=f"""
WITH RECURSIVE {_V}, {_ITEMS},
dated AS (SELECT *, CASE WHEN id % 9 = 4 THEN NULL ELSE CAST(DATE '2024-03-01' - CAST(id % 45 AS INTEGER) AS TIMESTAMP) END AS pubdate FROM items),
rows_ AS (SELECT * FROM dated WHERE pubdate IS NULL OR pubdate >= TIMESTAMP '2024-03-02 00:00:00' - INTERVAL 14 DAYS), {_GREEDY},
s AS (SELECT d.id, CASE WHEN d.id NOT IN (SELECT id FROM rows_) THEN 'expired' WHEN g.id IS NOT NULL THEN 'duplicate' ELSE 'kept' END AS state,
             g.anchor, len(d.vec) * 4 AS n FROM dated d LEFT JOIN gone g ON g.id = d.id)
SELECT CAST(id AS VARCHAR) AS id, state, CAST(anchor AS VARCHAR) AS anchor, CASE WHEN state = 'kept' THEN CAST(n AS BIGINT) END AS ivect_bytes FROM s""")
def q_cleanup(spark, sf):
    """R12 + K6: retention (14 days) -> near-duplicate removal, both times from
    the article and the index table at once; every row's outcome, with the bytes
    that the index table still holds."""
    store, purged, gone = _cleanup(spark, sf)
    first = next(v for v in store.history() if store.state(v)["tables"].get("articles", {}).get("path") and store.state(v)["tables"].get("index", {}).get("path"))
    return _states(store.read("articles", first), purged, gone, store.read("index"))


@register("q_cleanup_preview")
def q_cleanup_preview(spark, sf):
    """The ten newest rows that the cleanup keeps."""
    store, _, _ = _cleanup(spark, sf)
    kept = store.read("articles").withColumn("id", F.col("id").cast("string"))
    return news.preview(kept.select("id", "ticker", "headline", "summary", "pubdate"), limit=10)


def _news_batch(spark, sf):
    from riskfold.operators import corpus as C
    raw = B.raw_news(spark, sf)
    prep = news.preprocess(raw, order="Doc Id", keep=("lang",)).where("src_order is not null")
    # read twice below: among rows of one Doc Id the language decides which both see
    first = news.keep_first(prep, "id", ["src_order", "lang"])
    # articles in Spanish arrive without a summary: it is drawn from the whole article
    blank = F.when(F.col("lang") != "es", F.col("summary"))
    queue = first.where(F.col("lang") == "es").select("id", C.extractive_summary(F.col("summary")).alias("summary"))
    updated = news.update_column(first.withColumn("summary", blank).drop("lang", "src_order"), queue, "summary")
    tables = _new_store(spark)
    maintenance.create_tables(tables)
    store = tables.read("articles", tables.commit({"articles": updated}))
    encode = lambda arts: encode_articles(arts).select("id", "vec")
    purged, gone = maintenance.cleanup(tables, B.AS_OF, 14, 0.9, tile_size=512, encode=encode)
    maintenance.refresh_index(tables, encode_articles, B.AS_OF, 30)
    return store, tables, purged, gone


@register("q_news_batch")
def q_news_batch(spark, sf):
    """One whole news batch: preprocess -> insert-or-ignore -> summary
    queue -> retention + near-duplicate removal -> index build, every row's outcome."""
    store, tables, purged, gone = _news_batch(spark, sf)
    return _states(store, purged, gone, tables.read("index"))


@register("q_news_batch_preview")
def q_news_batch_preview(spark, sf):
    """The ten newest indexed rows of the batch."""
    _, tables, _, _ = _news_batch(spark, sf)
    index = tables.read("index").select("id", vectors.bytes_to_vector(F.col("ivect")).alias("ivect"))
    return news.preview(tables.read("articles"), index, limit=10)
