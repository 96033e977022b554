"""Edge cases of the scalar helpers (FIXTURES §1.3)."""

import datetime as dt

from pyspark.sql import functions as F

from riskfold.functions import dates as D
from riskfold.functions import numbers as N
from riskfold.functions import text as X
from riskfold.operators import portfolio


def test_extract_number_edge_cases(spark):
    df = spark.createDataFrame([("-5",), ("-0.5%",), ("1,234.5",), ("-.5",), ("N/A",), (None,)], "s string")
    got = [r.n for r in df.select(N.extract_number("s").alias("n")).collect()]
    assert got == [5.0, -0.5, 1.0, -0.5, None, None]


def test_parse_portfolio_text(spark):
    df = spark.createDataFrame([(1, " aapl 10, , brk.b 2.5, AAPL 3, bad item, MSFT .5 ")], "portfolio_id long, raw string")
    parsed = portfolio.parse_portfolio_text(df)
    pos = {(r.ticker, r.quantity) for r in portfolio.positions_from_text(parsed).collect()}
    assert pos == {("AAPL", 3.0), ("BRK-B", 2.5), ("MSFT", 0.5)}
    bad = [r.item for r in parsed.where("NOT ok").collect()]
    assert bad == ["bad item"]


def test_normalize_pubdate(spark):
    rows = [("January 5, 2025 at 3:00 PM",), ("5-Jan-25",), ("2025-01-05T03:00:00+09:00",), ("garbage",), ("",),
            (None,), ("Sept 9, 2024",), ("7-Mar-99",)]
    df = spark.createDataFrame(rows, "s string")
    got = [r.d for r in df.select(D.normalize_pubdate("s").alias("d")).collect()]
    assert got == [dt.date(2025, 1, 5), dt.date(2025, 1, 5), dt.date(2025, 1, 5), None, None, None,
                   dt.date(2024, 9, 9), dt.date(1999, 3, 7)]


def test_clean_html_unescapes_first(spark):
    df = spark.createDataFrame([("<p>A &amp; B</p>\n\n<b>x</b>  &lt;i&gt;y&lt;/i&gt;",), (None,)], "h string")
    got = [r.c for r in df.select(X.clean_html("h").alias("c")).collect()]
    assert got == ["A & B x y", ""]


def test_snake_and_symbols(spark):
    df = spark.createDataFrame([("Pub Date-Time (UTC)", " brk.b ", "Symbol")], "a string, b string, c string")
    r = df.select(X.snake("a").alias("s"), X.symbol_norm("b").alias("n"), X.not_header_word("c").alias("h")).collect()[0]
    assert (r.s, r.n, r.h) == ("pub_date_time_utc", "BRK-B", False)


def test_ratio_and_safe_div(spark):
    df = spark.createDataFrame([(27.1, 10.0, 0.0), (0.271, None, 2.0)], "m double, n double, d double")
    r = df.select(N.ratio_scale("m").alias("m"), N.safe_div("n", "d").alias("q"),
                  N.pick_or_derive(F.lit(0.0), F.lit(7.0)).alias("p")).collect()
    assert [x.m for x in r] == [0.271, 0.271]
    assert [x.q for x in r] == [None, None]
    assert r[0].p == 7.0


def test_fmt_metric(spark):
    df = spark.createDataFrame([(None,), (0.25,), (2.5e9,), (3.25e6,), (12.345,)], "x double")
    got = [r.t for r in df.select(N.fmt_metric("x").alias("t")).collect()]
    assert got == ["N/A", "0.25", "$2.5B", "$3.3M", "12.35"]
    assert df.select(N.fmt_metric(F.lit(0.0025), percent=True).alias("t")).first().t == "0.3%"


def test_clean_html_knows_every_entity(spark):
    df = spark.createDataFrame([("<b>caf&eacute;</b>&#8217;s &mdash; A&amp;B &lt;i&gt;x",), (None,)], "h string")
    got = [r.c for r in df.select(X.clean_html("h", full_entities=True).alias("c")).collect()]
    assert got == ["café ’s — A&B x", ""]
