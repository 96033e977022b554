"""Raw-document queries and the link refresh."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskfold.functions import text as X
from riskfold.operators import html, maintenance, news
from riskfold.plans import bindings as B
from riskfold.plans import news_plans as NP
from riskfold.plans.catalog import register
from riskfold.session import checkpoint_dir
from riskfold.sources.tables import read_table
from riskfold.sources.versioned import VersionedStore

_ENT = ("replace(replace(replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'),"
        " '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')")
_CLEAN = "coalesce(trim(regexp_replace(regexp_replace(" + _ENT + ", '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '')"


def clean_sql(c: str) -> str:
    return _CLEAN.format(c=c)


_EXTRACT = f"""
a AS (SELECT page_id, url, html,
             NULLIF(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '') AS art,
             NULLIF(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '') AS h1,
             NULLIF(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '') AS ttl,
             NULLIF(regexp_extract(html, '(?s)<div class="ad"[^>]*>(.*?)</div>', 1), '') AS ad,
             NULLIF(regexp_extract(html, '(?s)<footer[^>]*>(.*?)</footer>', 1), '') AS foot
      FROM pages),
b AS (SELECT *, regexp_replace(art, '(?s)<h1[^>]*>.*?</h1>', ' ', 'g') AS no_h1 FROM a),
c AS (SELECT *, list_filter(list_transform(string_split_regex(no_h1, '<p[^>]*>'), lambda x: {clean_sql('x')}),
                            lambda x: x <> '') AS chunks FROM b),
d AS (SELECT *, NULLIF(array_to_string(list_filter(chunks, lambda x, i: list_position(chunks, x) = i), '\n'), '') AS joined,
             NULLIF({clean_sql('no_h1')}, '') AS whole FROM c),
ex AS (SELECT page_id, url,
              coalesce(NULLIF(trim({clean_sql('h1')}), ''), NULLIF(trim({clean_sql('ttl')}), '')) AS title,
              CASE WHEN coalesce(length(whole), 0) > coalesce(length(joined), 0) THEN whole ELSE joined END AS body,
              {clean_sql('ad')} AS byline, {clean_sql('foot')} AS publisher
       FROM d)"""


@register("q_page_extract", sql=f"""
WITH {_EXTRACT}
SELECT page_id, title, body, byline, publisher, trim(split_part(body, chr(10), 1)) AS first_line,
       length(body) AS body_chars FROM ex""")
def q_page_extract(spark, sf):
    """S10 + A21 + F8 + F18: title / body / byline / publisher of every page."""
    e = html.extract_page(read_table(spark, sf, "pages"))
    return e.select("page_id", "title", "body", "byline", "publisher", "first_line",
                    F.length("body").cast("bigint").alias("body_chars"))


# Pages of the content filter's sources: the extracted ones, of which every
# seventh comes from a blocked publisher, every eleventh from the video desk,
# every thirteenth is a premium page and every seventeenth has no title; every
# fifth is already in the store.
_BLOCKED_SQL = "[" + ", ".join(f"'{p}'" for p in news.BLOCKED_PUBLISHERS) + "]"


def sourced_pages(spark, sf):
    e = html.extract_page(read_table(spark, sf, "pages"))
    k = F.col("page_id")

    def every(n, changed, column):
        return F.when(k % n == 0, changed).otherwise(F.col(column)).alias(column)

    publishers = F.array(*[F.lit(p) for p in news.BLOCKED_PUBLISHERS])
    name = F.element_at(publishers, (k % len(news.BLOCKED_PUBLISHERS)).cast("int") + 1)
    return e.select("page_id", every(17, F.lit(" "), "title"),
                    every(13, F.concat(F.lit(news.PREMIUM_MARKER + "\n"), F.coalesce("body", F.lit(""))), "body"),
                    every(11, F.lit("by " + news.VIDEO_BYLINE), "byline"), every(7, name, "publisher"))


@register("q_content_filter", sql=f"""
WITH {_EXTRACT},
m AS (SELECT page_id, CASE WHEN page_id % 17 = 0 THEN ' ' ELSE title END AS title,
             CASE WHEN page_id % 13 = 0 THEN 'PREMIUM' || chr(10) || coalesce(body, '') ELSE body END AS body,
             CASE WHEN page_id % 11 = 0 THEN 'by Yahoo Finance Video' ELSE byline END AS byline,
             CASE WHEN page_id % 7 = 0 THEN ({_BLOCKED_SQL})[CAST(page_id % 6 AS INTEGER) + 1] ELSE publisher END AS publisher
      FROM ex),
f AS (SELECT *, (trim(split_part(body, chr(10), 1)) = 'PREMIUM'
                 OR coalesce(contains(byline, 'Yahoo Finance Video'), false)
                 OR coalesce(list_bool_or(list_transform({_BLOCKED_SQL}, lambda p: contains(coalesce(publisher, ''), p))), false)) AS bad,
             coalesce(length(trim(title)), 0) > 0 AND coalesce(length(trim(body)), 0) > 0 AS ok
      FROM m)
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'stored' WHEN bad THEN 'rejected' WHEN ok THEN 'kept' ELSE 'dropped' END AS status
FROM f""")
def q_content_filter(spark, sf):
    """P15 + P16 + P18: every page's status: held by the store already and
    skipped, else premium / video / blocked-publisher rejects and the non-empty
    title+body rule."""
    stored = read_table(spark, sf, "pages").where(F.col("page_id") % 5 == 0).select("page_id")
    fresh = news.skip_populated(sourced_pages(spark, sf), stored, "page_id")
    return (fresh.select("page_id", news.content_status().alias("status"))
            .unionByName(stored.withColumn("status", F.lit("stored"))))


@register("q_html_list", sql=r"""
WITH li AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)) AS raw,
                   unnest(range(len(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)))) AS pos
            FROM pages),
s AS (SELECT page_id, pos, NULLIF(upper(regexp_replace(raw, '[^A-Za-z.]', '', 'g')), '') AS symbol FROM li)
SELECT page_id, CAST(pos AS INTEGER) AS pos, symbol FROM s
WHERE symbol IS NOT NULL AND upper(trim(symbol)) NOT IN ('SYMBOL', 'TICKER')
QUALIFY row_number() OVER (PARTITION BY page_id, symbol ORDER BY pos) = 1""")
def q_html_list(spark, sf):
    """Symbols listed in ``<li><a>`` lists of every page."""
    s = html.list_symbols(read_table(spark, sf, "pages"))
    return s.select("page_id", F.col("pos").cast("int").alias("pos"), "symbol")


def constituent_pages(spark, sf):
    """Constituent pages landed per nation and block of 500 supplier keys: a
    table of sizes first, then the one that names the symbols, whose column
    stands elsewhere on every other page."""
    s = read_table(spark, sf, "supplier").join(F.broadcast(read_table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    sym = F.concat(F.lower(B.symbol("s_suppkey")), F.when(F.col("s_suppkey") % 3 == 0, F.lit(".b")).otherwise(F.lit(" ")))
    turned = F.col("n_nationkey") % 2 == 0
    name = F.concat(F.lit("<td>"), html.xml_escape(F.col("s_name")), F.lit("</td>"))
    cell = F.concat(F.lit("<td><a href='#'>"), sym, F.lit("</a></td>"))
    row = F.concat(F.lit("<tr>"), F.when(turned, F.concat(cell, name)).otherwise(F.concat(name, cell)), F.lit("</tr>"))
    size = F.concat(F.lit("<tr><td>"), F.col("s_acctbal").cast("string"), F.lit("</td></tr>"))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", c.alias("x")))), lambda e: e["x"]), "")
    g = s.groupBy("n_nationkey", F.floor(F.col("s_suppkey") / 500).alias("blk")).agg(ordered(size).alias("sizes"), ordered(row).alias("rows"))
    heads = F.when(turned, F.lit("<th>Ticker Symbol</th><th>Company</th>")).otherwise(F.lit("<th>Company</th><th class='x'> <b>Ticker</b> </th>"))
    page = F.concat(F.lit("<html><table id='s'><tr><th>Size</th></tr>"), F.col("sizes"), F.lit("</table><p>text</p><table class='wikitable'><thead><tr>"), heads,
                    F.lit("</tr></thead><tbody>"), F.col("rows"), F.lit("</tbody></table></html>"))
    return g.select(F.concat_ws("/", F.col("n_nationkey").cast("string"), F.col("blk").cast("string")).alias("page_id"), page.alias("html"))


@register("q_html_table", sql="""
SELECT DISTINCT CAST(s_nationkey AS VARCHAR) || '/' || CAST(floor(s_suppkey / 500) AS BIGINT) AS page_id,
       translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') || CASE WHEN s_suppkey % 3 = 0 THEN '-B' ELSE '' END AS symbol,
       CAST(row_number() OVER (PARTITION BY s_nationkey, floor(s_suppkey / 500) ORDER BY s_suppkey) - 1 AS INTEGER) AS pos
FROM supplier""")
def q_html_table(spark, sf):
    """S9 + F3: symbols of the table that a header cell picks, on pages with two tables."""
    return html.table_symbols(constituent_pages(spark, sf)).select("page_id", "symbol", F.col("pos").cast("int").alias("pos"))


def article_pages(spark, sf):
    """Article pages landed per document: headline and date in the element that
    the document's language uses, its text in paragraphs of a line."""
    d = read_table(spark, sf, "documents").select("doc_id", "text", "lang")
    head, day = html.xml_escape(B.headline_of("text")), F.date_format(B.pubdate_of("doc_id"), "yyyy-MM-dd")
    title = (F.when(F.col("lang") == "en", F.concat(F.lit("<div class='x cover-headline'>"), head, F.lit("</div>")))
             .when(F.col("lang") == "de", F.concat(F.lit('<header class="caas-title-wrapper"><i>-</i><h1 id="a">'), head, F.lit("</h1></header>")))
             .when(F.col("lang") == "fr", F.concat(F.lit('<h1 data-testid="Heading">'), head, F.lit("</h1>")))
             .otherwise(F.concat(F.lit("<h1 class='other'>"), head, F.lit("</h1>"))))
    time = (F.when(day.isNull(), F.lit(""))
            .when(F.col("lang") == "en", F.concat(F.lit('<time class="byline-attr-meta-time" datetime="'), day, F.lit('">then</time>')))
            .otherwise(F.concat(F.lit('<time class="caas-attr-meta-time">'), day, F.lit("</time>"))))
    body = F.concat(F.lit("<p>"), F.replace(html.xml_escape(F.col("text")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    return d.select("doc_id", F.concat(F.lit("<html><body>"), title, time, F.lit("<article>"), F.coalesce(body, F.lit("")), F.lit("</article></body></html>")).alias("html"))


@register("q_article_fields", sql=f"""
WITH l AS (SELECT doc_id, lang, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
c AS (SELECT doc_id, n, {clean_sql("line")} AS line FROM l),
f AS (SELECT doc_id, line, min(n) AS n FROM c WHERE line <> '' GROUP BY 1, 2),
b AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS article FROM f GROUP BY 1)
SELECT d.doc_id, CASE WHEN lang <> 'es' THEN NULLIF({clean_sql("trim(regexp_extract(text, '^[^\n.!?]*[.!?]?', 0))")}, '') END AS headline,
       CASE WHEN doc_id % 9 <> 4 THEN strftime(DATE '2024-03-01' - CAST(doc_id % 45 AS INTEGER), '%Y-%m-%d') END AS pubdate,
       md5(b.article) AS article_md5
FROM documents d LEFT JOIN b USING (doc_id)""")
def q_article_fields(spark, sf):
    """S10 + A21: headline and date by ordered selectors, distinct paragraphs."""
    return html.article_fields(article_pages(spark, sf)).select("doc_id", "headline", "pubdate", F.md5("article").alias("article_md5"))


def feeds(spark, sf):
    """RSS feeds landed per (source, block of 20 documents), written from documents."""
    d = read_table(spark, sf, "documents").select("doc_id", "text", "source")
    pub = F.date_format(B.pubdate_of("doc_id"), "EEE, dd MMM yyyy HH:mm:ss '+0000'")
    item = F.concat(F.lit("<item><title>"), html.xml_escape(B.headline_of("text")),
                    F.lit("</title><description>"), html.xml_escape(F.col("text")),
                    F.lit("</description><pubDate>"), F.coalesce(pub, F.lit("")), F.lit("</pubDate></item>"))
    fid = F.concat_ws("/", F.col("source"), F.floor(F.col("doc_id") / 20).cast("string"))
    g = d.groupBy(fid.alias("feed_id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("x")))).alias("it"))
    xml = F.concat(F.lit("<rss><channel>"), F.array_join(F.transform("it", lambda e: e["x"]), ""),
                   F.lit("</channel></rss>"))
    return g.select("feed_id", xml.alias("xml"))


@register("q_feed_items", sql=f"""
WITH it AS (SELECT source || '/' || CAST(floor(doc_id / 20) AS BIGINT) AS feed_id, doc_id,
                   {clean_sql("trim(regexp_extract(text, '^[^\\n.!?]*[.!?]?', 0))")} AS headline,
                   {clean_sql("text")} AS summary
            FROM documents)
SELECT feed_id, headline, summary, CAST(k AS INTEGER) AS item_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY doc_id) AS k FROM it WHERE headline <> '')
WHERE k <= 3""")
def q_feed_items(spark, sf):
    """First three titled items of every landed RSS feed (from_xml)."""
    it = html.feed_items(feeds(spark, sf), limit=3)
    return it.select("feed_id", "headline", "summary", F.col("item_rank").cast("int").alias("item_rank"))


@register("q_search_links", sql=r"""
SELECT CAST(user_id AS VARCHAR) || '/' || CAST(blk AS VARCHAR) || '/' || event_type AS query, event_type AS kind, url AS link, CAST(k AS INTEGER) AS link_rank FROM (
  SELECT e.user_id, e.event_type, CAST(floor(e.event_id / 1000) AS BIGINT) AS blk, p.url,
         row_number() OVER (PARTITION BY e.user_id, e.event_type, floor(e.event_id / 1000) ORDER BY e.event_id) AS k
  FROM events e JOIN pages p ON p.page_id = CAST(json_extract_string(e.props, '$.k') AS BIGINT)
  WHERE starts_with(p.url, 'https://'))
WHERE k <= 10""")
def q_search_links(spark, sf):
    """S8 + P17: search responses (``{"news": [{"link": ...}]}``, one per
    user, kind of event and block of 1000 event ids, so no response grows with
    the data), written from all events -> first ten https links per response."""
    e = read_table(spark, sf, "events")
    p = read_table(spark, sf, "pages").select("page_id", "url")
    k = F.get_json_object("props", "$.k").cast("bigint")
    seen = e.select("user_id", "event_id", "event_type", k.alias("page_id")).join(p, "page_id")
    # one response document per user and kind, links in event order
    q = F.concat_ws("/", F.col("user_id").cast("string"), F.floor(F.col("event_id") / 1000).cast("string"), "event_type")
    resp = seen.groupBy(q.alias("query")).agg(
        F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "url"))),
                                       lambda x: F.struct(x["url"].alias("link"))).alias("news"))).alias("body"))
    out = html.search_links(resp, count=10, prefix="https://")
    return out.select("query", F.substring_index("query", "/", -1).alias("kind"), "link", F.col("link_rank").cast("int").alias("link_rank"))


@register("q_link_refresh", sql=f"""
WITH {NP._LINKS}, {_EXTRACT},
stored2 AS (SELECT s.ticker, s.link, e.title AS headline, e.body AS article
            FROM stored s JOIN pg ON pg.url = s.link LEFT JOIN ex e ON e.page_id = pg.page_id),
cleaned AS (SELECT * FROM stored2 WHERE NOT (headline IS NULL AND article IS NULL)),
cand AS (SELECT pg.ticker, pg.url AS link, e.title AS headline, e.body AS article, e.byline, e.publisher
         FROM pg JOIN ex e USING (page_id)),
newl AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cleaned s WHERE s.ticker IS NOT DISTINCT FROM c.ticker AND s.link = c.link)
                               AND NOT EXISTS (SELECT 1 FROM blocked b WHERE b.ticker IS NOT DISTINCT FROM c.ticker AND b.link = c.link)),
flt AS (SELECT *, (trim(split_part(article, chr(10), 1)) = 'PREMIUM' OR coalesce(contains(byline, 'Yahoo Finance Video'), false)
                   OR coalesce(list_bool_or(list_transform(['Motley Fool', 'Barchart', 'The Wall Street Journal', 'Zacks', 'Benzinga', 'Quartz'],
                                                          lambda p: contains(coalesce(publisher, ''), p))), false)) AS bad FROM newl)
SELECT ticker, link, length(article) AS article_chars, 'stored' AS origin FROM cleaned
UNION ALL
SELECT ticker, link, length(article), 'new' FROM flt
WHERE NOT bad AND coalesce(length(trim(headline)), 0) > 0 AND coalesce(length(trim(article)), 0) > 0
UNION ALL
SELECT ticker, link, NULL, 'blocked' FROM (SELECT ticker, link FROM blocked UNION SELECT ticker, link FROM flt WHERE bad)""")
def q_link_refresh(spark, sf):
    """R15 (P3 -> J6 -> extract / filter -> K2 / K11): one refresh over every
    host at once; the link table and the block list after it."""
    pages = read_table(spark, sf, "pages")
    ex = html.extract_page(pages).select("page_id", F.col("title").alias("headline"), F.col("body").alias("article"), "byline", "publisher")
    store = VersionedStore(spark, f"{checkpoint_dir(spark)}/links-{uuid.uuid4().hex}")
    maintenance.create_link_tables(store)
    before = NP.link_table(spark, sf).join(ex, F.col("src_order") == F.col("page_id"), "left")
    first = store.commit({"links": before, "blocked": NP.block_list(spark, sf).withColumn("src_order", F.lit(-1))})
    found = NP.link_candidates(spark, sf).join(ex, F.col("src_order") == F.col("page_id"))
    for _ in range(2):  # a batch that runs again changes nothing
        maintenance.refresh_links(store, found, batch="1")
    was = store.read("links", first).select("ticker", "link").withColumn("origin", F.lit("stored"))
    after = store.read("links").join(was, ["ticker", "link"], "left")
    size = F.length("article").cast("bigint").alias("article_chars")
    return (after.select("ticker", "link", size, F.coalesce("origin", F.lit("new")).alias("origin"))
            .unionByName(store.read("blocked").select("ticker", "link", F.lit(None).cast("bigint").alias("article_chars"), F.lit("blocked").alias("origin"))))
