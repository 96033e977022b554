"""Corpus, prompt and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfold import schemas
from riskfold.functions import numbers as N
from riskfold.operators import corpus as C
from riskfold.operators import fundamentals as FU
from riskfold.operators import news, portfolio, risk
from riskfold.plans import bindings as B
from riskfold.plans import fundamentals_plans as FP
from riskfold.plans import portfolio_plans as PP
from riskfold.plans import sql_fragments as S
from riskfold.plans.catalog import register
from riskfold.session import cut_lineage
from riskfold.sources.tables import read_table

NUMS = schemas.FUNDAMENTAL_NUMERIC


def fundamentals(spark, sf, small_side: bool = True):
    """One row per security.  ``small_side``: joined to a large text table as
    a broadcast side only after its size was checked
    (``broadcast_if_small``), so the text side streams with its own
    partitioning; otherwise left to the planner / AQE."""
    good, _ = FU.split_failures(FU.assemble(FU.wide_records(FP.provider_records(spark, sf))))
    if not small_side:
        return good
    from riskfold.session import broadcast_if_small
    return broadcast_if_small(good)


def news_ticker(source: F.Column) -> F.Column:
    """News source 'srcN' belongs to the security with key N + 1."""
    return B.symbol(F.substring(source, 4, 10).cast("long") + 1)


def corpus_news(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text", "source")
    return d.select("doc_id", news_ticker(F.col("source")).alias("ticker"), "text")


# ---------------------------------------------------------------- SQL --
def q(x):  # quoted column
    return f'"{x}"'


def s_dec(x, d):
    return f"round(CAST({x} AS DECIMAL(38, 6)), {d})"


def s_fmt_metric(x, percent=False):
    if percent:
        body = f"printf('%.1f%%', {s_dec(f'{x} * 100.0', 1)})"
    else:
        body = (f"CASE WHEN abs({x}) >= 1e9 THEN printf('$%.1fB', {s_dec(f'{x} / 1e9', 1)}) "
                f"WHEN abs({x}) >= 1e6 THEN printf('$%.1fM', {s_dec(f'{x} / 1e6', 1)}) "
                f"ELSE printf('%.2f', {s_dec(x, 2)}) END")
    return f"CASE WHEN {x} IS NULL THEN 'N/A' ELSE {body} END"


def s_pct(x):
    return f"printf('%.1f%%', {s_dec(f'{x} * 100.0', 1)})"


def s_money(x):
    return f"printf('%,.2f', {s_dec(x, 2)})"


def s_fixed(x, d):
    return f"printf('%.{d}f', {s_dec(x, d)})"


NEWS_TICKER_SQL = "translate(CAST(CAST(substr(source, 4) AS BIGINT) + 1 AS VARCHAR), '0123456789', 'ABCDEFGHIJ')"
FUND = FP._AGG + """,
good AS (SELECT * FROM fund WHERE NOT neg)"""

_EPS, _PM, _G = q("Diluted EPS (ttm)"), q("Profit Margin"), q("Quarterly Earnings Growth (yoy)")
_DE, _CR, _FCF = q("Total Debt/Equity (mrq)"), q("Current Ratio (mrq)"), q("Levered Free Cash Flow (ttm)")
_OCF = q("Operating Cash Flow (ttm)")

NOTES_SQL = f"""list_filter([
  CASE WHEN {_EPS} IS NOT NULL THEN printf('EPS는 %s로 수익성의 기준점 역할을 합니다.', {s_fmt_metric(_EPS)}) END,
  CASE WHEN {_PM} IS NOT NULL THEN printf('순이익률은 %s입니다.', {s_fmt_metric(_PM, True)}) END,
  CASE WHEN {_G} IS NOT NULL THEN printf('전년 대비 이익은 %s %s 흐름입니다.', {s_fmt_metric(_G, True)},
       CASE WHEN {_G} >= 0 THEN '성장' ELSE '둔화' END) END,
  CASE WHEN {_DE} IS NOT NULL THEN printf('부채비율은 %s로 %s합니다.', {s_fmt_metric(_DE)},
       CASE WHEN {_DE} < 1 THEN '레버리지 부담은 낮은 편' ELSE '부채 부담 점검이 필요' END) END,
  CASE WHEN {_CR} IS NOT NULL THEN printf('유동비율은 %s로 %s합니다.', {s_fmt_metric(_CR)},
       CASE WHEN {_CR} >= 1 THEN '단기 유동성은 양호' ELSE '단기 유동성은 보수적으로 볼 필요' END) END,
  CASE WHEN {_FCF} IS NOT NULL THEN printf('레버드 FCF는 %s입니다.', {s_fmt_metric(_FCF)}) END
], lambda x: x IS NOT NULL)"""

NOTES_FINAL = f"""CASE WHEN NOT has_row THEN ['{C.NOTE_NO_DATA}']
     WHEN len({NOTES_SQL}) = 0 THEN ['{C.NOTE_LIMITED}']
     ELSE ({NOTES_SQL})[1:5] END"""


@register("q_fin_notes", sql=f"""
WITH {S.UNIVERSE}, {FUND},
j AS (SELECT u.ticker AS uticker, g.*, g."Ticker" IS NOT NULL AS has_row
      FROM universe u LEFT JOIN good g ON g."Ticker" = translate(CAST(u.ticker AS VARCHAR), '0123456789', 'ABCDEFGHIJ'))
SELECT uticker AS ticker, array_to_string({NOTES_FINAL}, chr(10)) AS notes, CAST(len({NOTES_FINAL}) AS INTEGER) AS n_notes FROM j""")
def q_fin_notes(spark, sf):
    """N1 + F9: report notes of every security (first five of six)."""
    u = B.universe(spark, sf).select("ticker", B.symbol("ticker").alias("fsym"))
    f = fundamentals(spark, sf, small_side=False).withColumnRenamed("Ticker", "fsym").withColumn("_has", F.lit(True))
    j = u.join(f, "fsym", "left")
    notes = C.financial_notes(F.col("_has").isNotNull())
    return j.select("ticker", F.array_join(notes, "\n").alias("notes"), F.size(notes).alias("n_notes"))


_FIN_SQL = "concat_ws(chr(10), " + ",\n".join([
    f"CASE WHEN {_EPS} IS NOT NULL THEN printf('With EPS at %s, the firm demonstrates resilient profitability.', CAST(CAST({s_dec(_EPS, 4)} AS DOUBLE) AS VARCHAR)) END",
    f"CASE WHEN {_PM} IS NOT NULL THEN printf('Profit margin of %s highlights efficiency in generating net income.', {s_pct(_PM)}) END",
    f"CASE WHEN {q('Operating Margin (ttm)')} IS NOT NULL THEN printf('Operating margin of %s indicates cost efficiency.', {s_pct(q('Operating Margin (ttm)'))}) END",
    f"CASE WHEN {_G} IS NOT NULL THEN CASE WHEN {_G} >= 0 THEN printf('Earnings grew %s YoY, showing strong momentum.', {s_pct(_G)}) ELSE printf('Earnings declined %s YoY, signaling performance challenges.', {s_pct(_G)}) END END",
    f"CASE WHEN {q('Revenue (ttm)')} IS NOT NULL THEN printf('Revenue of %s underscores the company’s scale.', {s_money(q('Revenue (ttm)'))}) END",
    f"CASE WHEN {q('Gross Profit (ttm)')} IS NOT NULL THEN printf('Gross profit of %s provides a buffer for operations.', {s_money(q('Gross Profit (ttm)'))}) END",
    f"CASE WHEN {q('EBITDA')} IS NOT NULL THEN printf('EBITDA of %s reinforces operating strength.', {s_money(q('EBITDA'))}) END",
    f"CASE WHEN {q('Return on Assets(ROA) (ttm)')} IS NOT NULL THEN printf('ROA of %s shows asset utilization efficiency.', {s_pct(q('Return on Assets(ROA) (ttm)'))}) END",
    f"CASE WHEN {q('Return on Equity(ROE) (ttm)')} IS NOT NULL THEN printf('ROE of %s reflects shareholder return generation.', {s_pct(q('Return on Equity(ROE) (ttm)'))}) END",
    f"CASE WHEN {_DE} IS NOT NULL THEN printf('Debt-to-equity ratio of %s suggests %s.', {s_fixed(_DE, 2)}, CASE WHEN {_DE} < 1 THEN 'manageable leverage' ELSE 'high financial risk' END) END",
    f"CASE WHEN {_CR} IS NOT NULL THEN CASE WHEN {_CR} > 1 THEN printf('Current ratio of %s indicates short-term liquidity strength.', {s_fixed(_CR, 2)}) ELSE printf('Current ratio of %s raises liquidity concerns.', {s_fixed(_CR, 2)}) END END",
    f"CASE WHEN {_OCF} IS NOT NULL THEN printf('Operating cash flow of %s highlights robust core operations.', {s_money(_OCF)}) END",
    f"CASE WHEN {_FCF} IS NOT NULL THEN printf('Free cash flow of %s provides flexibility for reinvestment and returns.', {s_money(_FCF)}) END",
    f"CASE WHEN {q('Book Value Per Share (mrq)')} IS NOT NULL THEN printf('Book value per share of %s indicates intrinsic shareholder equity.', CAST(CAST({s_dec(q('Book Value Per Share (mrq)'), 4)} AS DOUBLE) AS VARCHAR)) END",
]) + ")"


def _any(words, t="lower(text)"):
    return "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"


_NEWS_PARTS = f"""list_filter([
  CASE WHEN {_any(C.GROWTH_WORDS)} AND {_G} IS NOT NULL THEN printf('Product or demand-related news aligns with earnings growth of %s, reinforcing momentum.', {s_pct(_G)}) END,
  CASE WHEN {_any(C.INVEST_WORDS)} AND {_FCF} IS NOT NULL THEN printf('Capital expenditure plans appear supported by free cash flow of %s.', {s_money(_FCF)}) END,
  CASE WHEN {_any(C.REGULATION_WORDS)} AND {_DE} IS NOT NULL THEN printf('Regulatory risks combined with D/E of %s may elevate financial vulnerability.', {s_fixed(_DE, 2)}) END,
  CASE WHEN {_any(C.SHAREHOLDER_WORDS)} AND {_FCF} IS NOT NULL THEN printf('Shareholder actions could be sustained by FCF of %s.', {s_money(_FCF)}) END,
  CASE WHEN {_any(C.GREEN_WORDS)} AND {_OCF} IS NOT NULL THEN printf('Sustainability initiatives may be financed by operating cash flow of %s.', {s_money(_OCF)}) END
], lambda x: x IS NOT NULL)"""
_NEWS_SQL = f"""CASE WHEN text IS NULL OR length(trim(text)) = 0 THEN 'No major news reported recently.'
  WHEN len({_NEWS_PARTS}) = 0 THEN 'The news has strategic significance, though financial impact remains uncertain.'
  ELSE array_to_string({_NEWS_PARTS}, ' ') END"""
_POS = f"""list_filter([CASE WHEN {_EPS} IS NOT NULL THEN 'solid profitability' END,
  CASE WHEN {_OCF} IS NOT NULL THEN 'strong operating cash flow' END,
  CASE WHEN {_FCF} IS NOT NULL AND {_FCF} > 0 THEN 'capacity for reinvestment' END], lambda x: x IS NOT NULL)"""
_NEG = f"""list_filter([CASE WHEN {_DE} IS NOT NULL AND {_DE} > 1 THEN 'high leverage' END,
  CASE WHEN {_CR} IS NOT NULL AND {_CR} < 1 THEN 'weak liquidity position' END], lambda x: x IS NOT NULL)"""
_OUT_SQL = f"""concat_ws(' ', CASE WHEN len({_POS}) > 0 THEN 'Positives include ' || array_to_string({_POS}, ', ') || '.' END,
  CASE WHEN len({_NEG}) > 0 THEN 'Risks stem from ' || array_to_string({_NEG}, ', ') || '.' END,
  'Overall, the company’s outlook depends on balancing financial strengths with external challenges.')"""
_METRICS_SQL = "concat_ws('; ', " + ", ".join(
    f"CASE WHEN {q(n)} IS NOT NULL THEN '{n}: ' || {s_fixed(q(n), 4)} END" for n in NUMS) + ")"


@register("q_instruction_rows", sql=f"""
WITH {FUND},
nw AS (SELECT doc_id, {NEWS_TICKER_SQL} AS ticker, text FROM documents),
j AS (SELECT nw.doc_id, nw.ticker, nw.text, g.* FROM nw JOIN good g ON g."Ticker" = nw.ticker)
SELECT doc_id, ticker,
  'Ticker: ' || ticker || chr(10) || 'Sector: ' || coalesce("Sector", 'N/A') || chr(10) || 'Industry: ' || coalesce("Industry", 'N/A')
    || chr(10) || 'Metrics: ' || {_METRICS_SQL} || chr(10) || 'News: ' || coalesce(text, '') AS input,
  '[Company Overview]' || chr(10) || upper(ticker) || ' operates in the ' || coalesce("Sector", 'N/A') || ' sector ('
    || coalesce("Industry", 'N/A') || ').' || chr(10) || chr(10) || '[Financial Analysis]' || chr(10) || {_FIN_SQL}
    || chr(10) || chr(10) || '[News Impact]' || chr(10) || {_NEWS_SQL} || chr(10) || chr(10) || '[Outlook]' || chr(10)
    || {_OUT_SQL} AS output
FROM j""")
def q_instruction_rows(spark, sf):
    """R1-R4 + J1 + F11 + N2: one (input, output) record per news article
    joined with its company's fundamentals."""
    j = corpus_news(spark, sf).join(fundamentals(spark, sf).withColumnRenamed("Ticker", "ticker"), "ticker")
    j = j.withColumn("_lt", F.lower("text"))   # lower-cased once per row
    inp, out = C.instruction_record(F.col("ticker"), F.col("text"), NUMS, F.col("_lt"))
    return j.select("doc_id", "ticker", inp.alias("input"), out.alias("output"))


COPIES = 3


def _slot(name: str) -> F.Column:
    """Template slot of one copy: md5 of (document, copy, pool)."""
    h = F.md5(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("copy").cast("string"), F.lit(name)))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(len(C.EPS_TEMPLATES))).cast("int")


def _template_sql(pool, name: str) -> str:
    listed = ", ".join("'" + t.replace("'", "''") + "'" for t in pool)
    slot = f"CAST('0x' || substr(md5(concat_ws('-', CAST(doc_id AS VARCHAR), CAST(copy AS VARCHAR), '{name}')), 1, 8) AS BIGINT) % {len(pool)}"
    return f"([{listed}])[1 + CAST({slot} AS INTEGER)]"


_AUG_NEWS = f"""list_filter([
  CASE WHEN {_any(('growth', 'launch', 'demand'))} AND {_G} IS NOT NULL THEN 'This aligns with earnings growth of ' || {s_pct(_G)} || '.' END,
  CASE WHEN {_any(('investment', 'factory'))} AND {_FCF} IS NOT NULL THEN 'Such investments may be funded by FCF of ' || {s_money(_FCF)} || '.' END
], lambda x: x IS NOT NULL)"""
_AUG_POS = f"""concat_ws(', ', CASE WHEN {_EPS} IS NOT NULL THEN 'profitability' END, CASE WHEN {_OCF} IS NOT NULL THEN 'cash generation' END)"""
_AUG_NEG = f"""concat_ws(', ', CASE WHEN {_DE} > 1 THEN 'high leverage' END, CASE WHEN {_CR} < 1 THEN 'weak liquidity' END)"""


@register("q_augment", sql=f"""
WITH {FUND},
nw AS (SELECT doc_id, {NEWS_TICKER_SQL} AS ticker, text FROM documents),
j AS (SELECT nw.doc_id, nw.ticker, nw.text, c.copy, g.* FROM nw JOIN good g ON g."Ticker" = nw.ticker
      CROSS JOIN (SELECT unnest(range({COPIES})) AS copy) c)
SELECT doc_id, ticker, CAST(copy AS INTEGER) AS copy, length('Ticker: ' || ticker || chr(10) || 'Sector: ' || coalesce("Sector", 'N/A') || chr(10)
    || 'Industry: ' || coalesce("Industry", 'N/A') || chr(10) || 'Metrics: ' || {_METRICS_SQL} || chr(10) || 'News: ' || coalesce(text, '')) AS input_chars,
  '[Company Overview]' || chr(10) || upper(ticker) || ' operates in the ' || coalesce("Sector", 'N/A') || ' sector ('
  || coalesce("Industry", 'N/A') || ').' || chr(10) || chr(10) || '[Financial Analysis]' || chr(10)
  || concat_ws(chr(10),
       CASE WHEN {_EPS} IS NOT NULL THEN replace({_template_sql(C.EPS_TEMPLATES, 'eps')}, '%s', CAST(CAST({s_dec(_EPS, 4)} AS DOUBLE) AS VARCHAR)) END,
       CASE WHEN {_G} >= 0 THEN 'Earnings grew ' || {s_pct(_G)} || ' YoY, showing momentum.'
            WHEN {_G} < 0 THEN 'Earnings declined ' || {s_pct(_G)} || ' YoY, raising concerns.' END,
       CASE WHEN {_DE} IS NOT NULL THEN 'Debt-to-equity ratio of ' || {s_fixed(_DE, 2)} || ' suggests '
            || CASE WHEN {_DE} < 1 THEN 'manageable leverage' ELSE 'elevated risk' END || '.' END)
  || chr(10) || chr(10) || '[News Impact]' || chr(10)
  || CASE WHEN text IS NULL OR length(trim(text)) = 0 THEN 'No major news reported recently.'
          WHEN len({_AUG_NEWS}) = 0 THEN 'The news may have strategic significance, though financial impact is uncertain.'
          ELSE array_to_string({_AUG_NEWS}, ' ') END
  || chr(10) || chr(10) || '[Outlook]' || chr(10)
  || concat_ws(' ', CASE WHEN {_AUG_POS} <> '' THEN 'Positives include ' || {_AUG_POS} || '.' END,
               CASE WHEN {_AUG_NEG} <> '' THEN 'Risks stem from ' || {_AUG_NEG} || '.' END,
               {_template_sql(C.OUTLOOK_TEMPLATES, 'outlook')}) AS output
FROM j""")
def q_augment(spark, sf):
    """R5 + R6: short-form variants of every record; each copy draws its two
    templates by a seeded hash.  The input text is checked by its length, as
    it is the same for all copies."""
    j = corpus_news(spark, sf).join(fundamentals(spark, sf).withColumnRenamed("Ticker", "ticker"), "ticker")
    inp, _ = C.instruction_record(F.col("ticker"), F.col("text"), NUMS, F.lower("text"))
    j = j.withColumn("input", inp).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    out = C.augmented_output(F.col("ticker"), F.col("text"), _slot("eps"), _slot("outlook"))
    return j.select("doc_id", "ticker", "copy", F.length("input").cast("bigint").alias("input_chars"), out.alias("output"))


@register("q_chat_render", sql="""
SELECT conv_id, '<|begin_of_text|>' || string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10)
       || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || '<|eot_id|>', '' ORDER BY turn)
       || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) AS rendered,
       CAST(count(*) AS INTEGER) AS n_turns
FROM conversations GROUP BY conv_id""")
def q_chat_render(spark, sf):
    """every conversation rendered with the chat template."""
    r = C.render_chat(read_table(spark, sf, "conversations"))
    return r.select("conv_id", "rendered", F.col("n_turns").cast("int").alias("n_turns"))


_COMPANY_SQL = ("concat_ws(chr(10), 'Ticker: ' || \"Ticker\", CASE WHEN \"Sector\" IS NOT NULL THEN 'Sector: ' || \"Sector\" END, "
                "CASE WHEN \"Industry\" IS NOT NULL THEN 'Industry: ' || \"Industry\" END, "
                + ", ".join(f"CASE WHEN {q(n)} IS NOT NULL THEN '{n}: ' || {s_fixed(q(n), 4)} END" for n in NUMS) + ")")


@register("q_prompt_rows", sql=f"""
WITH {FUND},
nw AS (SELECT {NEWS_TICKER_SQL} AS ticker, CAST(doc_id AS VARCHAR) AS id,
              trim(regexp_extract(text, '^[^\\n.!?]*[.!?]?', 0)) AS headline, text AS summary,
              CASE WHEN doc_id % 9 = 4 THEN NULL ELSE CAST(DATE '2024-03-01' - CAST(doc_id % 45 AS INTEGER) AS TIMESTAMP) END AS pubdate
       FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY coalesce(strftime(pubdate, '%Y-%m-%d %H:%M:%S'), id) DESC, id DESC) AS k
      FROM nw WHERE summary IS NOT NULL AND length(trim(summary)) > 0),
nl AS (SELECT ticker AS nt, string_agg('- ' || coalesce(strftime(pubdate, '%Y-%m-%d'), 'None') || ' | ' || headline || ': ' || summary,
                                 chr(10) ORDER BY k) AS news_text FROM r WHERE k <= 10 GROUP BY 1),
st AS (SELECT unnest(['SAFE', 'NEUTRAL', 'RISKY', 'AGGRESSIVE']) AS style)
SELECT g."Ticker" AS ticker, st.style,
  'Analyze all the provided data and generate a report tailored to the investor''s profile.' || chr(10) || chr(10)
  || '1. Investor Style: ' || upper(st.style) || chr(10) || chr(10)
  || '2. Company Under Review, Key Data from Corporate Filings:' || chr(10) || {_COMPANY_SQL} || chr(10) || chr(10)
  || '3. Recent News:' || chr(10) || coalesce(nl.news_text, 'No summarized news found.') || chr(10) AS user_prompt
FROM good g CROSS JOIN st LEFT JOIN nl ON nl.nt = g."Ticker" """)
def q_prompt_rows(spark, sf):
    """R9 + P22 + A20 + F14: system + user messages for every (company, style)."""
    f = fundamentals(spark, sf)
    d = read_table(spark, sf, "documents")
    arts = d.select(news_ticker(F.col("source")).alias("ticker"), F.col("doc_id").cast("string").alias("id"),
                    B.headline_of("text").alias("headline"), F.col("text").alias("summary"),
                    B.pubdate_of("doc_id").alias("pubdate"))
    nl = C.news_lines(arts, 10).withColumnRenamed("ticker", "_nt")
    styles = F.explode(F.array(*[F.lit(s) for s in C.STYLES]))
    p = f.join(nl, f.Ticker == nl._nt, "left").select("Ticker", styles.alias("style"),
                                                         C.company_lines(NUMS).alias("company"), "news_text")
    user = C.user_prompt(F.col("style"), F.col("company"), F.coalesce("news_text", F.lit("No summarized news found.")))
    msgs = F.array(F.struct(F.lit("system").alias("role"), F.lit(C.SYSTEM_PROMPT).alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))
    return p.select(F.col("Ticker").alias("ticker"), "style", msgs.alias("messages")).select(
        "ticker", "style", F.col("messages")[1]["content"].alias("user_prompt"))


_EXTRACT_SQL = """list_max(list_transform(list_filter(list_transform(string_split_regex({t}, '[.!?]+\\s+'), lambda s: trim(s)),
                                        lambda s: s <> ''),
                            lambda s, i: {{'w': len(string_split_regex(s, '\\s+')), 'o': -(i - 1), 's': s}})).s"""


@register("q_summary_queue", sql=f"""
WITH {S.PREP},
store AS (SELECT id, headline, ticker, CASE WHEN lang = 'es' THEN NULL ELSE summary END AS summary
          FROM prep QUALIFY row_number() OVER (PARTITION BY id ORDER BY src_order) = 1),
landed AS (SELECT p.headline, p.ticker, p.summary, p.src_order, r.pubdate AS day, NULLIF(trim(r.link), '') AS link, r.final_url
           FROM prep p JOIN raw r ON r.doc_id = p.src_order),
src AS (SELECT 0 AS k, headline, ticker, CASE WHEN day IS NOT NULL THEN summary END AS article, day, final_url AS url, src_order FROM landed WHERE final_url IS NOT NULL
        UNION ALL SELECT 1, headline, ticker, CASE WHEN day IS NOT NULL THEN summary END, day, link, src_order FROM landed WHERE link IS NOT NULL),
one AS (SELECT k, headline, ticker, arg_min(article, src_order) FILTER (article IS NOT NULL) AS article,
               arg_min(concat_ws(chr(10), 'Title: ' || headline, 'Published at: ' || day, 'URL: ' || url), src_order) AS lines FROM src GROUP BY 1, 2, 3),
look AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY headline, ticker ORDER BY k) = 1),
queue AS (SELECT s.id, s.ticker, coalesce(l.article, l.lines, s.headline) AS text,
                 CASE WHEN l.article IS NOT NULL THEN 'article' WHEN l.lines IS NOT NULL THEN 'metadata' ELSE 'headline' END AS text_from
          FROM store s LEFT JOIN look l ON l.headline = s.headline AND l.ticker = s.ticker WHERE s.summary IS NULL OR length(trim(s.summary)) = 0),
new AS (SELECT id, text_from, {_EXTRACT_SQL.format(t='text')} AS summary,
               length(printf('{C.SUMMARY_PROMPT.replace("'", "''")}', ticker, text)) AS prompt_chars FROM queue WHERE text <> '')
SELECT s.id, coalesce(n.summary, s.summary) AS summary, n.prompt_chars, n.text_from
FROM store s LEFT JOIN new n USING (id)""")
def q_summary_queue(spark, sf):
    """R10 + J9 + K5: articles without a summary get their best text (the
    article of the first of two crawl tables that knows headline and ticker,
    its metadata lines, else the headline), a prompt and an extractive summary,
    written back by key."""
    raw = B.raw_news(spark, sf)
    extra = raw.select(F.col("Doc Id").alias("src_order"), F.col("Lang").alias("lang"), F.col("PubDate").alias("day"),
                       F.nullif(F.trim("Link"), F.lit("")).alias("link"), F.col("Final URL").alias("final_url"))
    p = cut_lineage(news.preprocess(raw, order="Doc Id").join(extra, "src_order"))
    lang = F.when(F.col("lang") == "es", F.lit(None).cast("string")).otherwise(F.col("summary"))
    store = cut_lineage(news.keep_first(p.select("id", "headline", "ticker", lang.alias("summary"), "src_order"), "id", "src_order"))
    sources = [p.where(F.col(url).isNotNull()).select(
        "headline", "ticker", F.when(F.col("day").isNotNull(), F.col("summary")).alias("article"), "src_order",
        news.metadata_lines(Title="headline", Published_at="day", URL=url).alias("lines")) for url in ("final_url", "link")]
    queue = store.where(F.trim(F.coalesce("summary", F.lit(""))) == "").select("id", "headline", "ticker")
    wanted = queue.select("headline", "ticker").distinct()
    texts = news.best_texts([s.join(wanted, ["headline", "ticker"], "left_semi") for s in sources])
    look = queue.join(texts, ["headline", "ticker"], "left").withColumn("text", F.coalesce("article", "lines", "headline")).where("text != ''")
    origin = F.when(F.col("article").isNotNull(), "article").when(F.col("lines").isNotNull(), "metadata").otherwise("headline")
    new = look.select("id", C.extractive_summary(F.col("text")).alias("new"), origin.alias("text_from"),
                      F.length(C.summary_prompt(F.col("ticker"), F.col("text"))).alias("prompt_chars"))
    return store.join(new, "id", "left").select("id", F.coalesce("new", "summary").alias("summary"), "prompt_chars", "text_from")


# Report texts (Korean, as in the reference).
NEWS_IMPACT_YES = "최신 뉴스는 실적, 수요, 정책 또는 산업 변화가 해당 종목의 단기 리스크 해석에 반영될 수 있음을 보여줍니다."
NEWS_IMPACT_NO = "뉴스 조회 결과가 없어 현재는 재무 지표와 포트폴리오 리스크 중심으로 판단합니다."


# Fixed value: closing line of every report.
OUTLOOK = "포트폴리오 전체 성향과 함께 변동성, 베타, 섹터 집중도를 같이 확인하는 것이 좋습니다."
REPORT_NEWS = 3

_REPORTS = f"""
WITH {S.FULL_UNIVERSE}, {S.WEIGHTS}, {FUND},
h AS (SELECT w.portfolio_id, w.ticker, w.weight, u.sector AS usector, u.sigma, u.mdd, u.beta,
             translate(CAST(w.ticker AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS sym
      FROM w LEFT JOIN universe u USING (ticker)),
nw AS (SELECT {NEWS_TICKER_SQL} AS sym, CAST(doc_id AS VARCHAR) AS id, text,
              trim(regexp_extract(text, '^[^\n.!?]*[.!?]?', 0)) AS headline,
              CASE WHEN doc_id % 9 = 4 THEN NULL ELSE CAST(DATE '2024-03-01' - CAST(doc_id % 45 AS INTEGER) AS TIMESTAMP) END AS pubdate
       FROM documents),
nr AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY coalesce(strftime(pubdate, '%Y-%m-%d %H:%M:%S'), id) DESC, id DESC) AS k
       FROM nw WHERE text IS NOT NULL AND length(trim(text)) > 0),
nl AS (SELECT sym, count(*) AS n, string_agg(id || ' | ' || coalesce(strftime(pubdate, '%Y-%m-%d'), '') || ' | '
              || coalesce(NULLIF(headline, ''), 'Untitled'), chr(10) ORDER BY k) AS news
       FROM nr WHERE k <= {REPORT_NEWS} GROUP BY 1),
j AS (SELECT h.*, g.*, g."Ticker" IS NOT NULL AS has_row, coalesce(nl.n, 0) AS n_news, nl.news,
             coalesce(h.usector, g."Sector", 'Unknown') AS rsector
      FROM h LEFT JOIN good g ON g."Ticker" = h.sym LEFT JOIN nl ON nl.sym = h.sym),
rep AS (
SELECT portfolio_id, j.uticker AS ticker, round(weight, 4) AS weight, rsector AS sector, round(sigma, 4) AS sigma,
       round(mdd, 4) AS mdd, round(beta, 4) AS beta,
       sym || '는 포트폴리오의 ' || printf('%.1f', {s_dec('weight * 100.0', 1)}) || '%를 차지하며 ' || rsector || ' 섹터 노출을 만듭니다.' AS overview,
       array_to_string({NOTES_FINAL}, chr(10)) AS financial, CAST(len({NOTES_FINAL}) AS INTEGER) AS n_notes,
       CASE WHEN n_news > 0 THEN '{NEWS_IMPACT_YES}' ELSE '{NEWS_IMPACT_NO}' END AS news_impact,
       news, CAST(n_news AS INTEGER) AS n_news, '{OUTLOOK}' AS outlook
FROM j)"""
_REPORTS = _REPORTS.replace("h AS (SELECT w.portfolio_id, w.ticker,", "h AS (SELECT w.portfolio_id, w.ticker AS uticker,")


def report_news(spark, sf):
    """The newest articles of every security; an item names the article
    by id, so a long summary is not copied into every portfolio's report."""
    d = read_table(spark, sf, "documents")
    arts = d.select(news_ticker(F.col("source")).alias("ticker"), F.col("doc_id").cast("string").alias("id"),
                    B.headline_of("text").alias("headline"), F.col("text").alias("summary"),
                    B.pubdate_of("doc_id").alias("pubdate"))
    item = F.struct("rank", "id", F.coalesce(F.date_format("pubdate", "yyyy-MM-dd"), F.lit("")).alias("pubdate"),
                    F.coalesce(F.nullif("headline", F.lit("")), F.lit("Untitled")).alias("headline"))
    return (news.recent_per_ticker(arts, REPORT_NEWS).groupBy(F.col("ticker").alias("sym"))
            .agg(F.array_sort(F.collect_list(item)).alias("items")))


def report_rows(spark, sf):
    """R7 + J11: one report per (portfolio, holding).  Holdings without risk
    metrics, fundamentals or news stay, with the defaults of each part."""
    w, u = PP.weights_and_universe(spark, sf, B.FULL_OBS)
    h = w.select("portfolio_id", "ticker", "weight").join(u, "ticker", "left").withColumn("sym", B.symbol("ticker"))
    f = (fundamentals(spark, sf, small_side=False).withColumnRenamed("Ticker", "fsym").drop("Industry")
         .withColumnRenamed("Sector", "fsector").withColumn("_has", F.lit(True)))
    j = h.join(f, h.sym == f.fsym, "left").join(report_news(spark, sf), "sym", "left")
    sector = F.coalesce("sector", "fsector", F.lit(risk.UNKNOWN_SECTOR))
    overview = F.concat(F.col("sym"), F.lit("는 포트폴리오의 "), F.format_string("%.1f", N._dec(F.col("weight") * 100.0, 1)),
                        F.lit("%를 차지하며 "), sector, F.lit(" 섹터 노출을 만듭니다."))
    return j.select("portfolio_id", "ticker", F.round("weight", 4).alias("weight"), sector.alias("sector"),
                    *[F.round(x, 4).alias(x) for x in ("sigma", "mdd", "beta")], overview.alias("overview"),
                    C.financial_notes(F.col("_has").isNotNull()).alias("financial"),
                    F.when(F.size("items") > 0, NEWS_IMPACT_YES).otherwise(NEWS_IMPACT_NO).alias("news_impact"),
                    F.coalesce("items", F.expr("cast(array() as array<struct<rank:int,id:string,pubdate:string,headline:string>>)"))
                    .alias("news"), F.lit(OUTLOOK).alias("outlook"))


@register("q_reports", sql=_REPORTS + """
SELECT portfolio_id, ticker, weight, sector, sigma, mdd, beta, overview, financial, news_impact, news, n_news, outlook FROM rep""")
def q_reports(spark, sf):
    """R7 + J11 + N1 + W8: one report row per (portfolio, holding)."""
    line = F.transform("news", lambda e: F.concat_ws(" | ", e["id"], e["pubdate"], e["headline"]))
    return report_rows(spark, sf).select(
        "portfolio_id", "ticker", "weight", "sector", "sigma", "mdd", "beta", "overview",
        F.array_join("financial", "\n").alias("financial"), "news_impact",
        F.when(F.size("news") > 0, F.array_join(line, "\n")).alias("news"), F.size("news").alias("n_news"), "outlook")


@register("q_report_json", sql=_REPORTS + """
SELECT portfolio_id, ticker, weight, sector, sigma, beta, overview, n_notes, n_news,
       split_part(news, ' | ', 1) AS newest_id, outlook FROM rep""")
def q_report_json(spark, sf):
    """K12 + N6: nested JSON report documents (risk struct, notes array, news
    array), read back field by field."""
    r = report_rows(spark, sf)
    doc = F.to_json(F.struct("ticker", "weight", "sector", F.struct("sigma", "mdd", "beta").alias("risk"), "overview",
                             "financial", "news_impact", "news", "outlook"))
    back = F.from_json("report", "ticker bigint, weight double, sector string, risk struct<sigma:double, beta:double>, "
                       "overview string, financial array<string>, news array<struct<id:string>>, outlook string")
    return r.select("portfolio_id", doc.alias("report")).select("portfolio_id", back.alias("b")).select(
        "portfolio_id", "b.ticker", "b.weight", "b.sector", "b.risk.sigma", "b.risk.beta", "b.overview",
        F.size("b.financial").alias("n_notes"), F.size("b.news").alias("n_news"),
        F.get("b.news", F.lit(0))["id"].alias("newest_id"), "b.outlook")


@register("q_portfolio_doc", sql=PP._SCORE_CTES + """,
al AS (SELECT portfolio_id, CAST(round(CAST(max(total_value) AS DECIMAL(38, 6)), 2) AS DOUBLE) AS total_value, count(*) AS n_positions,
              string_agg(CAST(ticker AS VARCHAR), ',' ORDER BY weight DESC, ticker) AS allocation FROM w GROUP BY 1),
hl AS (SELECT portfolio_id, string_agg(CAST(ticker AS VARCHAR) || '/' || sector, ',' ORDER BY weight DESC, ticker) AS holdings
       FROM j WHERE m GROUP BY 1),
sl AS (SELECT portfolio_id, string_agg(sector, ',' ORDER BY sw DESC, sector) AS sectors FROM sec GROUP BY 1)
SELECT portfolio_id, total_value, n_positions, allocation, holdings, sectors,
       CASE WHEN nm > 0 THEN round(score, 4) + 0.0 END AS srisk,
       CASE WHEN nm > 0 THEN CASE WHEN score < 0.33 THEN 'SAFE' WHEN score < 0.66 THEN 'NEUTRAL' ELSE 'AGGRESSIVE' END END AS category
FROM al JOIN s USING (portfolio_id) JOIN sl USING (portfolio_id) LEFT JOIN hl USING (portfolio_id)""")
def q_portfolio_doc(spark, sf):
    """The result document of every portfolio: score, category, total
    value, and allocation, holdings and sectors by weight.  A list holds at
    most one entry per security of the universe."""
    w, u = PP.weights_and_universe(spark, sf)
    w, u = cut_lineage(w), cut_lineage(u)       # positions by security; read by all parts of the document

    def listed(weight, key, entry):
        rows = F.array_sort(F.collect_list(F.struct((-F.col(weight)).alias("o"), F.col(key).alias("k"), entry.alias("e"))))
        return F.array_join(F.transform(rows, lambda r: r["e"]), ",")

    key = F.col("ticker").cast("string")
    alloc = w.groupBy("portfolio_id").agg(N.round_money(F.max("total_value"), 2).alias("total_value"),
                                          F.count("*").alias("n_positions"),
                                          listed("weight", "ticker", key).alias("allocation"))
    held = w.select("portfolio_id", "ticker", "weight").join(u, "ticker")
    hold = held.groupBy("portfolio_id").agg(
        listed("weight", "ticker", F.concat_ws("/", key, F.col("sector"))).alias("holdings"))
    sec = portfolio.sector_exposure(w, u, digits=15)
    sectors = sec.groupBy("portfolio_id").agg(listed("sector_weight", "sector", F.col("sector")).alias("sectors"))
    score = risk.score_portfolios(w, u).select("portfolio_id", "srisk", "category")
    return alloc.join(score, "portfolio_id").join(sectors, "portfolio_id").join(hold, "portfolio_id", "left")


@register("q_dashboard", sql=PP._SCORE_CTES + f""",
t AS (SELECT ticker FROM universe ORDER BY sigma DESC, ticker LIMIT 12)
SELECT (SELECT count(*) FROM universe) AS ticker_count,
       (SELECT count(DISTINCT sector) FROM universe) AS n_sectors,
       (SELECT string_agg(CAST(ticker AS VARCHAR), ',' ORDER BY CAST(ticker AS VARCHAR)) FROM t) AS top_volatile,
       portfolio_id AS default_portfolio, CASE WHEN nm > 0 THEN round(score, 4) + 0.0 END AS default_srisk
FROM s WHERE portfolio_id = (SELECT min(portfolio_id) FROM s)""")
def q_dashboard(spark, sf):
    """R14 + T1 + T5 + A18: start-up figures (ticker count, sectors, the 12
    most volatile securities) and the score of the default portfolio."""
    w, u = PP.weights_and_universe(spark, sf)
    u = cut_lineage(u)
    first = w.select(F.min("portfolio_id")).scalar()
    score = risk.score_portfolios(w.where(F.col("portfolio_id") == first), u)
    tops = risk.top_by(u, "sigma", 12).select(
        F.array_join(F.array_sort(F.collect_list(F.col("ticker").cast("string"))), ",").alias("t")).scalar()
    return score.select(u.select(F.count("*")).scalar().alias("ticker_count"),
                        u.select(F.countDistinct("sector")).scalar().alias("n_sectors"), tops.alias("top_volatile"),
                        F.col("portfolio_id").alias("default_portfolio"), F.col("srisk").alias("default_srisk"))


@register("q_start_page", sql=PP._SCORE_CTES + f""",
opt AS (SELECT {S.SYMBOL.format('ticker')} AS name, sector AS label FROM universe
        UNION SELECT {S.SYMBOL.format('s_suppkey')}, coalesce(n_name, 'Unknown') FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey),
t AS (SELECT ticker, sector, sigma FROM universe ORDER BY sigma DESC, ticker LIMIT 12)
SELECT 'option' AS part, name, label, CAST(NULL AS DOUBLE) AS value FROM opt
UNION ALL SELECT 'count', 'tickers', NULL, CAST((SELECT count(*) FROM universe) AS DOUBLE)
UNION ALL SELECT 'top', {S.SYMBOL.format('ticker')}, sector, round(sigma, 4) FROM t
UNION ALL SELECT 'default', CAST(portfolio_id AS VARCHAR),
       CASE WHEN nm > 0 THEN CASE WHEN score < 0.33 THEN 'SAFE' WHEN score < 0.66 THEN 'NEUTRAL' ELSE 'AGGRESSIVE' END END,
       CASE WHEN nm > 0 THEN round(score, 4) + 0.0 END FROM s WHERE portfolio_id = (SELECT min(portfolio_id) FROM s)
UNION ALL SELECT 'investor', c.c_name,
       CASE WHEN nm > 0 THEN CASE WHEN score < 0.33 THEN 'SAFE' WHEN score < 0.66 THEN 'NEUTRAL' ELSE 'AGGRESSIVE' END END,
       CASE WHEN nm > 0 THEN round(score, 4) + 0.0 END FROM s JOIN customer c ON c.c_custkey = s.portfolio_id""")
def q_start_page(spark, sf):
    """R14 (T1 T5 A18 R8 S4): rows of the start page: options of both universes,
    ticker count, the 12 most volatile securities, the result of the default
    portfolio, and the investor scores that an earlier scoring run stored as
    CSV."""
    import uuid
    from riskfold.session import checkpoint_dir
    from riskfold.sources import files
    w, u = PP.weights_and_universe(spark, sf)
    u = cut_lineage(u)
    scores = cut_lineage(risk.score_portfolios(w, u).select("portfolio_id", "category", "srisk"))
    path = f"{checkpoint_dir(spark)}/tables/scores-{uuid.uuid4().hex[:12]}"
    names = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("portfolio_id"), F.col("c_name").alias("investor"))
    files.write_csv(scores.join(names, "portfolio_id").select("investor", "category", "srisk"), path)

    def part(df, name, key, label, value):
        return df.select(F.lit(name).alias("part"), key.cast("string").alias("name"), label.cast("string").alias("label"),
                         value.cast("double").alias("value"))

    none = F.lit(None)
    symbol = B.symbol(F.col("ticker"))
    options = (u.select("ticker", "sector").unionByName(
        B.sectors(spark, sf).select("ticker", F.coalesce("sector", F.lit("Unknown")).alias("sector"))).distinct())
    first = scores.select(F.min("portfolio_id")).scalar()
    parts = [part(options, "option", symbol, F.col("sector"), none),
             part(u.agg(F.count("*").alias("n")), "count", F.lit("tickers"), none, F.col("n")),
             part(risk.top_by(u, "sigma", 12), "top", symbol, F.col("sector"), F.col("sigma")),
             part(scores.where(F.col("portfolio_id") == first), "default", F.col("portfolio_id"), F.col("category"), F.col("srisk")),
             part(files.load_scores(spark, path), "investor", F.col("investor"), F.col("category"), F.col("srisk"))]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@register("q_report_fundamentals", sql=f"""
WITH {FP._AGG}
SELECT coalesce(f."Ticker", translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ')) AS "Ticker",
       coalesce(f."Sector", CASE WHEN s_suppkey IS NOT NULL THEN 'stored' END) AS "Sector",
       coalesce(f."Industry", CASE WHEN s_suppkey IS NOT NULL THEN 'stored' END) AS "Industry",
       round(coalesce(f."Revenue (ttm)", s_acctbal), 6) AS revenue
FROM (SELECT * FROM fund WHERE NOT neg) f
FULL JOIN supplier ON translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') = f."Ticker"
""")
def q_report_fundamentals(spark, sf):
    """J11 (S3 M4): fundamentals of the reports: the records of this run over
    the stored CSV of an earlier one, column by column; tickers of either."""
    import uuid
    from riskfold.session import checkpoint_dir
    from riskfold.sources import files
    earlier = read_table(spark, sf, "supplier").select(
        F.lower(B.symbol("s_suppkey")).alias("Ticker"), F.lit("stored").alias("Sector"), F.lit("stored").alias("Industry"),
        F.col("s_acctbal").alias("Revenue (ttm)"))
    path = f"{checkpoint_dir(spark)}/tables/earlier-{uuid.uuid4().hex[:12]}"
    files.write_csv(schemas.conform(earlier, schemas.FUNDAMENTALS_SCHEMA), path)
    stored = schemas.conform(files.load_fundamentals(spark, path), schemas.FUNDAMENTALS_SCHEMA)
    both = FU.override_stored(fundamentals(spark, sf, small_side=False), stored)
    return both.select("Ticker", "Sector", "Industry", F.round(F.col("`Revenue (ttm)`"), 6).alias("revenue"))
