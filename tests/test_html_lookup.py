"""HTML tables and selectors, ordered article look-up, symbol resolver."""

from pyspark.sql import functions as F

from riskfold.operators import html, news, search


def page(spark, *bodies):
    return spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "page_id long, html string")


def test_table_chosen_by_header_cell(spark):
    wrong = "<table><tr><th>Rank</th><th>Tickers</th></tr><tr><td>1</td><td>NOT</td></tr></table>"
    right = ("<TABLE></TABLE><table class='a'><thead><tr>\n<th>Company</th><th scope=col> <i>Ticker&nbsp;symbol</i></th></tr></thead><tbody>"
             "<tr><td>Berk</td><td><a href='x'> brk.b </a></td></tr><tr><th>Head</th><td>aa</td></tr><tr><td>short</td></tr>"
             "<tr><td>again</td><td>AA</td></tr><tr><td>empty</td><td> </td></tr></tbody></table>")
    later = "<table><tr><th>Ticker</th></tr><tr><td>zz</td></tr></table>"
    pages = page(spark, wrong + right + later, wrong, "", None, later, "<table><tr><td>no</td></tr></table>" + later)
    got = sorted((r.page_id, r.pos, r.symbol) for r in html.table_symbols(pages).collect())
    assert got == [(0, 0, "BRK-B"), (0, 1, "AA"), (4, 0, "ZZ"), (5, 0, "ZZ")]


def test_selectors_in_order(spark):
    pages = page(
        spark,
        "<h1 data-testid='Heading'>third</h1><header class=\"a caas-title-wrapper b\"><p>x</p><h1>second</h1></header><div class='cover-headline'> </div>",
        "<p class='not-cover-headline-either'>no</p><span id=1 class=\"big cover-headline\">first &amp; <b>bold</b></span><h1 data-testid=\"Heading\">third</h1>"
        "<time class='caas-attr-meta-time' datetime='2024-01-02'>text</time><p>one</p><p>two</p><p>one</p><p> </p>",
        "<time class='caas-attr-meta-time' datetime=''>3 Jan</time><h1>plain</h1>",
        "<div class='byline-attr-meta-time'>first date</div><time class='caas-attr-meta-time' datetime='later'>x</time>", None)
    got = [(r.headline, r.pubdate, r.article) for r in html.article_fields(pages).orderBy("page_id").collect()]
    assert got == [("second", None, "x"), ("first & bold", "2024-01-02", "no\none\ntwo"), (None, "3 Jan", None), (None, "first date", None), (None, None, None)]


def test_best_text_of_ordered_sources(spark):
    schema = "headline string, ticker string, article string, lines string, src_order long"
    first = spark.createDataFrame([("h1", "t", None, "l1", 1), ("h1", "t", "late", "l2", 3), ("h1", "t", "early", "l3", 2), ("h2", "t", None, "m2", 9), ("h2", "t", None, "m1", 5)], schema)
    second = spark.createDataFrame([("h1", "t", "other source", "x", 0), ("h2", "t", "would do", "x", 0), ("h3", "t", "only here", "x", 0), ("h3", "u", None, "lines", 0)], schema)
    got = {(r.headline, r.ticker): (r.article, r.lines) for r in news.best_texts([first, second]).collect()}
    assert got == {("h1", "t"): ("early", None), ("h2", "t"): (None, "m1"), ("h3", "t"): ("only here", None), ("h3", "u"): (None, "lines")}
    line = spark.sql("select 'a' x, cast(null as string) y, 3 z").select(news.metadata_lines(Title="x", Published_at="y", URL="z").alias("l")).first().l
    assert line == "Title: a\nURL: 3"


def test_resolver_prefers_the_exact_symbol(spark):
    options = spark.createDataFrame([("AB", "Tech"), ("ABC", "Energy"), ("XAB", "Tech")], "ticker string, sector string")
    typed = spark.createDataFrame([(1, " ab "), (2, "abc"), (3, "bc"), (4, "ener"), (5, "zzz"), (6, ""), (7, None)], "query_id long, query string")
    got = {r.query_id: (r.resolved, r.exact) for r in search.resolve(typed, options).collect()}
    assert got == {1: ("AB", True), 2: ("ABC", True), 3: ("ABC", False), 4: ("ABC", False), 5: (None, False), 6: (None, False), 7: (None, False)}


def test_index_keeps_asked_substrings_and_ids_may_repeat(spark):
    options = spark.createDataFrame([("ABC", "Energy"), ("AB", "Food")], "ticker string, sector string")
    asked = spark.createDataFrame([("ab",), ("zz",)], "sub string")
    assert {(r.ticker, r["sub"], r.score) for r in search.substring_index(options, asked=asked).collect()} == {("ABC", "ab", 1), ("AB", "ab", 0)}
    typed = spark.createDataFrame([(1, "ab"), (2, " "), (3, "bc"), (3, "bc"), (None, "ab")], "query_id long, query string")
    got = sorted(((r.query_id or 0, r.query, r.resolved, r.exact) for r in search.resolve(typed, options).collect()), key=str)
    assert got == [(0, "ab", None, False), (1, "ab", "AB", True), (2, " ", None, False)] + [(3, "bc", "ABC", False)] * 4
