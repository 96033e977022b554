"""Raw-document jobs over landed text columns.

Every page / feed is parsed inside one row with built-in expressions
(``regexp_extract``, ``from_xml``, higher-order array functions), so the
work partitions with the rows; nothing is fetched or parsed on the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskfold.functions import text as X

FEED_SCHEMA = "channel STRUCT<item: ARRAY<STRUCT<title: STRING, description: STRING, pubDate: STRING>>>"


def _first(html: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def extract_page(pages: DataFrame, html: str = "html") -> DataFrame:
    """S10 + A21 + F8 + F18: title (h1, else <title>), body (distinct
    cleaned paragraph chunks joined by newlines, or the whole cleaned article
    when that is longer), byline (ad block), publisher (footer), first line."""
    h = F.col(html)
    article = _first(h, r"(?s)<article[^>]*>(.*?)</article>")
    title = X.first_non_blank(X.clean_html(_first(h, r"(?s)<h1[^>]*>(.*?)</h1>")),
                              X.clean_html(_first(h, r"(?s)<title[^>]*>(.*?)</title>")))
    no_h1 = F.regexp_replace(article, r"(?s)<h1[^>]*>.*?</h1>", " ")
    chunks = F.filter(F.transform(F.split(no_h1, r"<p[^>]*>"), lambda c: X.clean_html(c)), lambda c: c != "")
    joined = F.array_join(F.array_distinct(chunks), "\n")
    whole = X.clean_html(no_h1)
    body = X.longest(F.nullif(joined, F.lit("")), F.nullif(whole, F.lit("")))
    return pages.select(
        "*",
        title.alias("title"),
        body.alias("body"),
        X.clean_html(_first(h, r"(?s)<div class=\"ad\"[^>]*>(.*?)</div>")).alias("byline"),
        X.clean_html(_first(h, r"(?s)<footer[^>]*>(.*?)</footer>")).alias("publisher"),
        X.first_line(body).alias("first_line"))


def list_symbols(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Anchor texts of ``<li><a href>`` lists as symbols: cleaned (F4),
    header words dropped (P20), first occurrence per page kept (A19)."""
    items = F.regexp_extract_all(F.col(html), F.lit(r"<li><a href=\"[^\"]*\">([^<]*)</a></li>"), 1)
    x = pages.select(key, F.posexplode(items).alias("pos", "raw"))
    x = x.withColumn("symbol", X.symbol_clean("raw")).where(F.col("symbol").isNotNull() & X.not_header_word("symbol"))
    w = Window.partitionBy(key, "symbol").orderBy("pos")
    return x.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


# Header cells that name the symbol column, and the ordered selectors of
# an article's headline and date (the first that finds text wins).
SYMBOL_HEADERS = ("ticker", "ticker symbol")
HEADLINE_SELECTORS = (("", "cover-headline", ""), ("header", "caas-title-wrapper", "h1"), ("h1", "@data-testid=Heading", ""))
DATE_SELECTORS = (("", "byline-attr-meta-time", ""), ("time", "caas-attr-meta-time", ""))


def selector_pattern(tag: str, name: str, inner: str = "") -> str:
    """Pattern of an element by tag ("" for any), class or ``@attribute=value``,
    and an element inside it: group 2 holds its attributes, group 3 its content."""
    attribute, value = name[1:].split("=") if name.startswith("@") else ("class", name)
    inside = re.escape(value) if attribute != "class" else rf"(?:[^\"']*\s)?{re.escape(value)}(?:\s[^\"']*)?"
    start = rf"<({tag or '[a-zA-Z][a-zA-Z0-9]*'})\b([^>]*\b{re.escape(attribute)}\s*=\s*[\"']{inside}[\"'][^>]*)>"
    return rf"(?s){start}(.*?)</\1\s*>" if not inner else rf"(?s){start}.*?<{inner}\b[^>]*>(.*?)</{inner}\s*>"


def select_first(html: Column, selectors, attribute: str | None = None) -> Column:
    """Cleaned text of the first selector that finds any; with ``attribute`` its
    value goes before the text."""
    found = []
    for selector in selectors:
        pattern = selector_pattern(*selector)
        if attribute:
            found.append(X.clean_html(F.regexp_extract(F.regexp_extract(html, pattern, 2), rf"\b{attribute}\s*=\s*[\"']([^\"']*)[\"']", 1)))
        found.append(X.clean_html(F.regexp_extract(html, pattern, 3)))
    return X.first_non_blank(*found)


def article_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """Headline and date by ordered selectors (a date element's ``datetime``
    before its text), and the article's distinct paragraphs."""
    h = F.col(html)
    chunks = F.transform(F.regexp_extract_all(h, F.lit(r"(?s)<p\b[^>]*>(.*?)</p\s*>"), 1), lambda c: X.clean_html(c))
    article = F.array_join(F.array_distinct(F.filter(chunks, lambda c: c != "")), "\n")
    return pages.select("*", select_first(h, HEADLINE_SELECTORS).alias("headline"),
                        select_first(h, DATE_SELECTORS, "datetime").alias("pubdate"), F.nullif(article, F.lit("")).alias("article"))


def table_symbols(pages: DataFrame, html: str = "html", key: str = "page_id", headers=SYMBOL_HEADERS) -> DataFrame:
    """The symbols of a page's first table that has a header cell of
    ``headers``: that column's cells, normalised, empty ones and repeats
    dropped.  Pages without such a table give no rows."""
    def cells(row: Column, tags: str) -> Column:
        return F.transform(F.regexp_extract_all(row, F.lit(rf"(?s)<(?:{tags})\b[^>]*>(.*?)</(?:{tags})\s*>"), 1), lambda c: X.clean_html(c))

    def described(table: Column) -> Column:
        heads = F.transform(cells(table, "th"), lambda c: F.lower(c))
        places = F.filter(F.transform(heads, lambda h, i: F.when(h.isin(*headers), i)), lambda i: i.isNotNull())
        return F.struct(F.get(places, 0).alias("place"), table.alias("body"))

    tables = F.transform(F.regexp_extract_all(F.col(html), F.lit(r"(?s)<table\b[^>]*>(.*?)</table\s*>"), 1), described)
    chosen = F.get(F.filter(tables, lambda t: t["place"].isNotNull()), 0)
    rows = F.filter(F.regexp_extract_all(F.col("t.body"), F.lit(r"(?s)<tr\b[^>]*>(.*?)</tr\s*>"), 1), lambda r: F.rlike(r, F.lit(r"<td\b")))
    x = pages.select(key, chosen.alias("t")).select(key, "t.place", F.posexplode(rows).alias("pos", "row"))
    x = x.select(key, "pos", X.symbol_norm(F.get(cells(F.col("row"), "td|th"), F.col("place"))).alias("symbol"))
    x = x.where(F.col("symbol").isNotNull() & (F.col("symbol") != ""))
    return x.groupBy(key, "symbol").agg(F.min("pos").alias("pos"))


def xml_escape(c: Column) -> Column:
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def feed_items(feeds: DataFrame, xml: str = "xml", key: str = "feed_id", limit: int = 3) -> DataFrame:
    """RSS ``channel/item`` rows (title, description, pubDate cleaned),
    items without a title skipped, the first ``limit`` per feed kept."""
    parsed = feeds.select(key, F.from_xml(F.col(xml), FEED_SCHEMA).alias("rss"))
    items = parsed.select(key, F.posexplode(F.col("rss.channel.item")).alias("pos", "it"))
    items = items.select(key, "pos",
                         X.clean_html(F.col("it.title")).alias("headline"),
                         X.clean_html(F.col("it.description")).alias("summary"),
                         X.clean_html(F.col("it.pubDate")).alias("pubdate"))
    items = items.where(F.col("headline") != "")
    w = Window.partitionBy(key).orderBy("pos")
    return items.withColumn("item_rank", F.row_number().over(w)).where(F.col("item_rank") <= limit)


def search_links(responses: DataFrame, body: str = "body", key: str = "query", count: int = 10,
                 prefix: str | None = None) -> DataFrame:
    """S8 + P17: ``{"news": [{"link": ...}]}`` responses -> first ``count``
    links per query (optionally only links with a prefix)."""
    parsed = responses.select(key, F.from_json(F.col(body), "news ARRAY<STRUCT<link: STRING>>").alias("j"))
    links = parsed.select(key, F.posexplode("j.news").alias("pos", "n")).select(key, "pos", F.col("n.link").alias("link"))
    links = links.where(F.col("link").isNotNull())
    if prefix:
        links = links.where(F.col("link").startswith(prefix))
    w = Window.partitionBy(key).orderBy("pos")
    return links.withColumn("link_rank", F.row_number().over(w)).where(F.col("link_rank") <= count)
