"""Corpus, prompt and report text as column expressions (R1-R10, N1, N2,
F11, F14, F15, P22, A20, J1).

Every text is built per row with built-in string / array functions.  Number
rendering (deviation, see README): money amounts use two decimals with
thousands separators and all fixed-decimal numbers are rounded half-up
through a decimal first, so results do not depend on binary tie rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskfold.functions import numbers as N
from riskfold.functions import text as X


def c(name: str) -> Column:
    return F.col(f"`{name}`")


def present(name: str) -> Column:
    return c(name).isNotNull() & ~F.isnan(c(name))


def money(col: Column) -> Column:
    return F.format_string("%,.2f", N._dec(col, 2))


def pct(col: Column) -> Column:
    return N.fmt_percent(col, 1)


def fixed2(col: Column) -> Column:
    return N.fmt_fixed(col, 2)


def plain(col: Column) -> Column:
    """A raw number as text, rounded half-up to 4 decimals first."""
    return N._dec(col, 4).cast("string")


def _when(name: str, text: Column) -> Column:
    return F.when(present(name), text)


def lines(parts, sep: str) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), sep)


# ------------------------------------------------------ financial notes --
# Note texts of the report (Korean, as in the reference).
NOTE_NO_DATA = "재무 지표 데이터가 없어 뉴스와 리스크 지표 중심으로 해석합니다."
NOTE_LIMITED = "사용 가능한 핵심 재무 지표가 제한적입니다."


def financial_notes(has_row: Column, max_notes: int = 5, leverage_limit: float = 1.0) -> Column:
    """N1 + F9: up to six conditional notes, first ``max_notes`` kept; a
    default note when nothing applies or no fundamentals row exists."""
    g = c("Quarterly Earnings Growth (yoy)")
    de = c("Total Debt/Equity (mrq)")
    cr = c("Current Ratio (mrq)")
    notes = F.array_compact(F.array(
        _when("Diluted EPS (ttm)", F.format_string("EPS는 %s로 수익성의 기준점 역할을 합니다.",
                                                   N.fmt_metric(c("Diluted EPS (ttm)")))),
        _when("Profit Margin", F.format_string("순이익률은 %s입니다.", N.fmt_metric(c("Profit Margin"), percent=True))),
        _when("Quarterly Earnings Growth (yoy)", F.format_string(
            "전년 대비 이익은 %s %s 흐름입니다.", N.fmt_metric(g, percent=True),
            F.when(g >= 0, F.lit("성장")).otherwise(F.lit("둔화")))),
        _when("Total Debt/Equity (mrq)", F.format_string(
            "부채비율은 %s로 %s합니다.", N.fmt_metric(de),
            F.when(de < leverage_limit, F.lit("레버리지 부담은 낮은 편")).otherwise(F.lit("부채 부담 점검이 필요")))),
        _when("Current Ratio (mrq)", F.format_string(
            "유동비율은 %s로 %s합니다.", N.fmt_metric(cr),
            F.when(cr >= 1, F.lit("단기 유동성은 양호")).otherwise(F.lit("단기 유동성은 보수적으로 볼 필요")))),
        _when("Levered Free Cash Flow (ttm)", F.format_string("레버드 FCF는 %s입니다.",
                                                              N.fmt_metric(c("Levered Free Cash Flow (ttm)"))))))
    cut = F.slice(notes, 1, max_notes)
    return (F.when(~has_row, F.array(F.lit(NOTE_NO_DATA)))
            .when(F.size(cut) == 0, F.array(F.lit(NOTE_LIMITED))).otherwise(cut))


# ------------------------------------------------- instruction records --
# Keyword families of the news paragraph (substring tests).
GROWTH_WORDS = ("growth", "demand", "launch", "ai", "semiconductor", "expansion")
INVEST_WORDS = ("investment", "factory", "capex", "r&d", "expansion")
REGULATION_WORDS = ("regulation", "lawsuit", "recall", "sanction")
SHAREHOLDER_WORDS = ("dividend", "buyback", "shareholder")
GREEN_WORDS = ("climate", "sustainability", "green", "esg")


# The sentences below.
def financial_paragraph() -> Column:
    """Up to 14 conditional sentences, newline-joined."""
    g, d, cr = c("Quarterly Earnings Growth (yoy)"), c("Total Debt/Equity (mrq)"), c("Current Ratio (mrq)")
    return lines([
        _when("Diluted EPS (ttm)", F.format_string("With EPS at %s, the firm demonstrates resilient profitability.",
                                                   plain(c("Diluted EPS (ttm)")))),
        _when("Profit Margin", F.format_string("Profit margin of %s highlights efficiency in generating net income.",
                                               pct(c("Profit Margin")))),
        _when("Operating Margin (ttm)", F.format_string("Operating margin of %s indicates cost efficiency.",
                                                        pct(c("Operating Margin (ttm)")))),
        _when("Quarterly Earnings Growth (yoy)", F.when(
            g >= 0, F.format_string("Earnings grew %s YoY, showing strong momentum.", pct(g))).otherwise(
            F.format_string("Earnings declined %s YoY, signaling performance challenges.", pct(g)))),
        _when("Revenue (ttm)", F.format_string("Revenue of %s underscores the company’s scale.", money(c("Revenue (ttm)")))),
        _when("Gross Profit (ttm)", F.format_string("Gross profit of %s provides a buffer for operations.",
                                                    money(c("Gross Profit (ttm)")))),
        _when("EBITDA", F.format_string("EBITDA of %s reinforces operating strength.", money(c("EBITDA")))),
        _when("Return on Assets(ROA) (ttm)", F.format_string("ROA of %s shows asset utilization efficiency.",
                                                             pct(c("Return on Assets(ROA) (ttm)")))),
        _when("Return on Equity(ROE) (ttm)", F.format_string("ROE of %s reflects shareholder return generation.",
                                                             pct(c("Return on Equity(ROE) (ttm)")))),
        _when("Total Debt/Equity (mrq)", F.format_string(
            "Debt-to-equity ratio of %s suggests %s.", fixed2(d),
            F.when(d < 1, F.lit("manageable leverage")).otherwise(F.lit("high financial risk")))),
        _when("Current Ratio (mrq)", F.when(cr > 1, F.format_string(
            "Current ratio of %s indicates short-term liquidity strength.", fixed2(cr))).otherwise(
            F.format_string("Current ratio of %s raises liquidity concerns.", fixed2(cr)))),
        _when("Operating Cash Flow (ttm)", F.format_string("Operating cash flow of %s highlights robust core operations.",
                                                           money(c("Operating Cash Flow (ttm)")))),
        _when("Levered Free Cash Flow (ttm)", F.format_string(
            "Free cash flow of %s provides flexibility for reinvestment and returns.",
            money(c("Levered Free Cash Flow (ttm)")))),
        _when("Book Value Per Share (mrq)", F.format_string("Book value per share of %s indicates intrinsic shareholder equity.",
                                                            plain(c("Book Value Per Share (mrq)")))),
    ], "\n")


def news_paragraph(text: Column, lowered: Column | None = None) -> Column:
    """R2 + F11: keyword families x metric presence; blank text -> fixed
    sentence.  ``lowered`` is the lower-cased text when the caller has it
    (computed once per row)."""
    g, fcf = c("Quarterly Earnings Growth (yoy)"), c("Levered Free Cash Flow (ttm)")
    lt = lowered if lowered is not None else F.lower(text)

    def kw(words):
        return X.keyword_any(lt, words, lowered=True)

    parts = F.array_compact(F.array(
        F.when(present("Quarterly Earnings Growth (yoy)") & kw(GROWTH_WORDS), F.format_string(
            "Product or demand-related news aligns with earnings growth of %s, reinforcing momentum.", pct(g))),
        F.when(present("Levered Free Cash Flow (ttm)") & kw(INVEST_WORDS), F.format_string(
            "Capital expenditure plans appear supported by free cash flow of %s.", money(fcf))),
        F.when(present("Total Debt/Equity (mrq)") & kw(REGULATION_WORDS), F.format_string(
            "Regulatory risks combined with D/E of %s may elevate financial vulnerability.",
            fixed2(c("Total Debt/Equity (mrq)")))),
        F.when(present("Levered Free Cash Flow (ttm)") & kw(SHAREHOLDER_WORDS), F.format_string(
            "Shareholder actions could be sustained by FCF of %s.", money(fcf))),
        F.when(present("Operating Cash Flow (ttm)") & kw(GREEN_WORDS), F.format_string(
            "Sustainability initiatives may be financed by operating cash flow of %s.",
            money(c("Operating Cash Flow (ttm)"))))))
    body = F.when(F.size(parts) == 0, F.array(F.lit(
        "The news has strategic significance, though financial impact remains uncertain."))).otherwise(parts)
    return F.when(X.is_blank(text), F.lit("No major news reported recently.")).otherwise(F.array_join(body, " "))


# The sentences below.
def outlook_paragraph() -> Column:
    """R3 + N2: positives / negatives lists -> sentences + closing sentence."""
    pos = F.array_compact(F.array(
        F.when(present("Diluted EPS (ttm)"), F.lit("solid profitability")),
        F.when(present("Operating Cash Flow (ttm)"), F.lit("strong operating cash flow")),
        F.when(present("Levered Free Cash Flow (ttm)") & (c("Levered Free Cash Flow (ttm)") > 0),
               F.lit("capacity for reinvestment"))))
    neg = F.array_compact(F.array(
        F.when(present("Total Debt/Equity (mrq)") & (c("Total Debt/Equity (mrq)") > 1), F.lit("high leverage")),
        F.when(present("Current Ratio (mrq)") & (c("Current Ratio (mrq)") < 1), F.lit("weak liquidity position"))))
    return lines([
        F.when(F.size(pos) > 0, F.concat(F.lit("Positives include "), F.array_join(pos, ", "), F.lit("."))),
        F.when(F.size(neg) > 0, F.concat(F.lit("Risks stem from "), F.array_join(neg, ", "), F.lit("."))),
        F.lit("Overall, the company’s outlook depends on balancing financial strengths with external challenges.")], " ")


def metric_lines(numeric_cols) -> Column:
    """Metrics rendered as 'name: value' pairs (4 decimals) of present values."""
    return lines([_when(n, F.concat(F.lit(f"{n}: "), N.fmt_fixed(c(n), 4))) for n in numeric_cols], "; ")


def instruction_record(ticker: Column, text: Column, numeric_cols,
                       lowered: Column | None = None) -> tuple[Column, Column]:
    """(input, output) texts of one joined news x fundamentals row."""
    sector = F.coalesce(c("Sector"), F.lit("N/A"))
    industry = F.coalesce(c("Industry"), F.lit("N/A"))
    inp = F.concat(F.lit("Ticker: "), ticker, F.lit("\nSector: "), sector, F.lit("\nIndustry: "), industry,
                   F.lit("\nMetrics: "), metric_lines(numeric_cols), F.lit("\nNews: "), F.coalesce(text, F.lit("")))
    out = F.concat(F.lit("[Company Overview]\n"), F.upper(ticker), F.lit(" operates in the "), sector,
                   F.lit(" sector ("), industry, F.lit(").\n\n[Financial Analysis]\n"), financial_paragraph(),
                   F.lit("\n\n[News Impact]\n"), news_paragraph(text, lowered), F.lit("\n\n[Outlook]\n"),
                   outlook_paragraph())
    return inp, out


# ---------------------------------------------------------- augmentation --
# Template pools of the augmented corpus.
EPS_TEMPLATES = ("EPS of %s indicates solid profitability.",
                 "The company reported EPS of %s, showing earnings strength.",
                 "With EPS at %s, the firm demonstrates resilient performance.",
                 "Per-share earnings reached %s, reflecting profitability.",
                 "Reported EPS stood at %s, underlining earnings capacity.")
OUTLOOK_TEMPLATES = ("Overall, the company is positioned for growth, though risks must be monitored.",
                     "The outlook remains balanced, with financial strengths offset by challenges.",
                     "We maintain a cautiously optimistic outlook given profitability and cash flow.",
                     "The company faces risks, but fundamentals suggest resilience.",
                     "Future performance will hinge on managing leverage while sustaining growth.")


def augmented_output(ticker: Column, text: Column, eps_slot: Column, outlook_slot: Column) -> Column:
    """R5 + R6: short-form output; each template pool has its own slot (0-based)."""
    g, d = c("Quarterly Earnings Growth (yoy)"), c("Total Debt/Equity (mrq)")
    eps_t = F.element_at(F.array(*[F.lit(t) for t in EPS_TEMPLATES]), eps_slot + 1)
    out_t = F.element_at(F.array(*[F.lit(t) for t in OUTLOOK_TEMPLATES]), outlook_slot + 1)
    fin = lines([
        _when("Diluted EPS (ttm)", F.printf(eps_t, plain(c("Diluted EPS (ttm)")))),
        _when("Quarterly Earnings Growth (yoy)", F.when(g >= 0, F.format_string("Earnings grew %s YoY, showing momentum.",
                                                                                pct(g)))
              .otherwise(F.format_string("Earnings declined %s YoY, raising concerns.", pct(g)))),
        _when("Total Debt/Equity (mrq)", F.format_string("Debt-to-equity ratio of %s suggests %s.", fixed2(d),
                                                         F.when(d < 1, F.lit("manageable leverage"))
                                                         .otherwise(F.lit("elevated risk"))))], "\n")
    t = F.lower(text)
    parts = F.array_compact(F.array(
        F.when(present("Quarterly Earnings Growth (yoy)") & X.keyword_any(t, ("growth", "launch", "demand"), True),
               F.format_string("This aligns with earnings growth of %s.", pct(g))),
        F.when(present("Levered Free Cash Flow (ttm)") & X.keyword_any(t, ("investment", "factory"), True),
               F.format_string("Such investments may be funded by FCF of %s.", money(c("Levered Free Cash Flow (ttm)"))))))
    news = F.when(X.is_blank(text), F.lit("No major news reported recently.")).otherwise(
        F.when(F.size(parts) == 0, F.lit("The news may have strategic significance, though financial impact is uncertain."))
        .otherwise(F.array_join(parts, " ")))
    pos = F.array_compact(F.array(F.when(present("Diluted EPS (ttm)"), F.lit("profitability")),
                                  F.when(present("Operating Cash Flow (ttm)"), F.lit("cash generation"))))
    neg = F.array_compact(F.array(
        F.when(present("Total Debt/Equity (mrq)") & (d > 1), F.lit("high leverage")),
        F.when(present("Current Ratio (mrq)") & (c("Current Ratio (mrq)") < 1), F.lit("weak liquidity"))))
    outlook = lines([F.when(F.size(pos) > 0, F.concat(F.lit("Positives include "), F.array_join(pos, ", "), F.lit("."))),
                     F.when(F.size(neg) > 0, F.concat(F.lit("Risks stem from "), F.array_join(neg, ", "), F.lit("."))),
                     out_t], " ")
    sector = F.coalesce(c("Sector"), F.lit("N/A"))
    industry = F.coalesce(c("Industry"), F.lit("N/A"))
    return F.concat(F.lit("[Company Overview]\n"), F.upper(ticker), F.lit(" operates in the "), sector,
                    F.lit(" sector ("), industry, F.lit(").\n\n[Financial Analysis]\n"), fin,
                    F.lit("\n\n[News Impact]\n"), news, F.lit("\n\n[Outlook]\n"), outlook)


# ---------------------------------------------------------- chat render --
# Chat template markers and the begin-of-text token.
BOS = "<|begin_of_text|>"
HDR_START, HDR_END, EOT = "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>"


def strip_ws(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def render_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text", add_generation_prompt: bool = True) -> DataFrame:
    """one rendered prompt per conversation: begin token, header per
    message, trimmed content, end-of-turn marker, optional generation tail."""
    piece = F.concat(F.lit(HDR_START), F.col(role), F.lit(HDR_END + "\n\n"), strip_ws(F.col(text)), F.lit(EOT))
    g = turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), piece.alias("p"))))
                                .alias("m"))
    tail = HDR_START + "assistant" + HDR_END + "\n\n" if add_generation_prompt else ""
    body = F.array_join(F.transform("m", lambda e: e["p"]), "")
    return g.select(conv, F.concat(F.lit(BOS), body, F.lit(tail)).alias("rendered"), F.size("m").alias("n_turns"))


# --------------------------------------------------------------- prompts --
# Report styles and the system prompt of the report model.
STYLES = ("SAFE", "NEUTRAL", "RISKY", "AGGRESSIVE")
SYSTEM_PROMPT = """You are an expert financial analyst. Your mission is to write a concise, objective investment report for a client based on their specific risk profile.

ANALYSIS INSTRUCTIONS:
- Use BOTH the provided financial metrics ("Facts") and recent news ("News").
- Do not hallucinate numbers that are not in Facts.
- Adjust the focus and tone strictly based on the investor's style.
- Do NOT provide direct financial advice or buy/sell recommendations.

OUTPUT REPORT TEMPLATE
Report for: A (investor_style) Investor
Company: (company_name)

1. Executive Summary:
   (One concise paragraph aligned with the investor style.)

2. Key Analysis & Highlights:
   (5-7 bullet points. Each bullet should connect a financial metric with relevant news.)

3. Concluding Remark:
   (One or two sentences summarizing current standing for this type of investor.)
"""


def news_lines(news: DataFrame, n: int = 10, ticker: str = "ticker") -> DataFrame:
    """A20 + W8: '- date | headline: summary' lines of the latest n articles
    per ticker, joined by newlines (bounded: n lines per ticker)."""
    from riskfold.operators.news import sort_key_recent
    w = Window.partitionBy(ticker).orderBy(sort_key_recent().desc(), F.col("id").desc())
    r = news.where(~X.is_blank("summary")).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    line = F.concat(F.lit("- "), F.coalesce(F.date_format("pubdate", "yyyy-MM-dd"), F.lit("None")), F.lit(" | "),
                    F.col("headline"), F.lit(": "), F.col("summary"))
    return r.groupBy(ticker).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_k"), line.alias("l")))),
                                 lambda e: e["l"]), "\n").alias("news_text"))


def company_lines(numeric_cols) -> Column:
    """P22: 'name: value' lines of the non-null fundamentals."""
    return X.kv_lines([("Ticker", c("Ticker")), ("Sector", c("Sector")), ("Industry", c("Industry"))] +
                      [(n, F.when(c(n).isNotNull(), N.fmt_fixed(c(n), 4))) for n in numeric_cols])


def user_prompt(style: Column, company: Column, news: Column) -> Column:
    """the user message of a report prompt."""
    return F.concat(F.lit("Analyze all the provided data and generate a report tailored to the investor's profile.\n\n"
                          "1. Investor Style: "), F.upper(style),
                    F.lit("\n\n2. Company Under Review, Key Data from Corporate Filings:\n"), company,
                    F.lit("\n\n3. Recent News:\n"), news, F.lit("\n"))


# ------------------------------------------------------- summary queue --
# Fixed value: the prompt of the summary model.
SUMMARY_PROMPT = """You are an expert financial analyst focused on %s.
News:
%s
Instructions:
1) Extract objective, verifiable financial facts.
2) Use only facts explicitly present in the provided news text or metadata.
3) No opinions, predictions, or outside context.
Summary:"""


def summary_prompt(focus: Column, article: Column) -> Column:
    """summarisation prompt with the whole article (P23's cut would lose
    what stands after it)."""
    return F.format_string(SUMMARY_PROMPT, focus, article)


def extractive_summary(text: Column) -> Column:
    """Default pluggable summariser: the sentence with the most words in the
    whole text (first one on ties)."""
    sents = F.filter(F.transform(F.split(text, r"[.!?]+\s+"), lambda s: F.trim(s)), lambda s: s != "")
    scored = F.transform(sents, lambda s, i: F.struct(F.size(F.split(s, r"\s+")).alias("w"), (-i).alias("o"),
                                                      s.alias("s")))
    best = F.array_max(scored)
    return best["s"]
