"""Date / time column helpers (X1-X6).  Timestamps stay TIMESTAMP_NTZ in UTC
wall-clock terms so results do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
          "november", "december")
_SHORT = "|".join(m[:3] for m in MONTHS)
# a month word, a day with an optional ordinal ending, a year
_NAMED = rf"\b(?:{_SHORT})[a-z]*"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
MONTH_FIRST = rf"(?i)({_NAMED})\.?\s+{_DAY},?\s+(\d{{4}})\b"
DAY_FIRST = rf"(?i)\b{_DAY}[\s-]+({_NAMED})\.?,?[\s-]+(\d{{4}}|\d{{2}})\b"
YEAR_FIRST = r"^\s*(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
SLASHED = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\b"

# Fixed value: the publish-date column names, in priority order.
PUB_COLUMNS = ("pubdate", "pub_date", "date", "time", "published_time", "created_at")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _month_number(word: Column) -> Column:
    """1-12 for a month's name or a beginning of it (3 letters or more; also
    'sept'), else null."""
    w = F.lower(word)
    names = F.array(*[F.lit(m) for m in MONTHS])
    at = F.array_position(F.transform(names, lambda m: F.substring(m, 1, 3)), F.substring(w, 1, 3))
    return F.when((at > 0) & F.startswith(F.get(names, (at - 1).cast("int")), w), at)


def _day_of(year: Column, month: Column, day: Column) -> Column:
    """A date, or null when the parts make none."""
    return F.to_date(F.try_to_timestamp(F.concat_ws("-", year.cast("string"), month.cast("string"), day), F.lit("yyyy-M-d")))


def normalize_pubdate(c, pivot_year: int = 2024) -> Column:
    """First 'Mon D, YYYY' match, else first 'D Mon YYYY' / 'D-Mon-YY'
    match (RFC 2822 dates too), else an ISO date or M/D/YYYY at the start;
    returns a DATE (null when unparseable).  A two-digit year maps to the
    century that keeps it below ``pivot_year`` + 50."""
    s = _c(c).cast("string")
    part = lambda pattern, k: F.regexp_extract(s, pattern, k)
    year = part(DAY_FIRST, 3)
    short = F.when(F.length(year) == 2, F.lit(2000) + year.cast("int"))
    full = F.when(short >= pivot_year + 50, short - 100).when(short.isNotNull(), short).otherwise(F.nullif(year, F.lit("")).cast("int"))
    return (F.when(part(MONTH_FIRST, 0) != "", _day_of(part(MONTH_FIRST, 3), _month_number(part(MONTH_FIRST, 1)), part(MONTH_FIRST, 2)))
            .when(part(DAY_FIRST, 0) != "", _day_of(full, _month_number(part(DAY_FIRST, 2)), part(DAY_FIRST, 1)))
            .when(part(YEAR_FIRST, 0) != "", _day_of(part(YEAR_FIRST, 1), part(YEAR_FIRST, 2), part(YEAR_FIRST, 3)))
            .when(part(SLASHED, 0) != "", _day_of(part(SLASHED, 3), part(SLASHED, 1), part(SLASHED, 2))))


def pubdate_timestamp(c) -> Column:
    """X1 tail: normalised date -> midnight TIMESTAMP_NTZ (UTC wall clock)."""
    return F.to_timestamp_ntz(F.date_format(normalize_pubdate(c), "yyyy-MM-dd"))


def pubdate_text(c) -> Column:
    """Text form used inside article ids: 'YYYY-MM-DD 00:00:00+00:00' or 'NaT'."""
    return F.coalesce(F.date_format(_c(c), "yyyy-MM-dd HH:mm:ss'+00:00'"), F.lit("NaT"))


def date_like_columns(df: DataFrame) -> list[str]:
    """Names containing 'date' or 'time' or ending in '_at'."""
    return [c for c in df.columns if "date" in c or "time" in c or c.endswith("_at")]


def parse_date_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Cast every date-like column to a timestamp; bad values -> null."""
    for c in date_like_columns(df):
        if c in skip or dict(df.dtypes)[c] in ("timestamp", "timestamp_ntz", "date"):
            continue
        df = df.withColumn(c, F.coalesce(F.try_to_timestamp(F.col(c).cast("string")),
                                         F.to_timestamp_ntz(F.date_format(normalize_pubdate(c), "yyyy-MM-dd"))))
    return df


def pick_pub_column(df: DataFrame) -> str | None:
    """First present publish-date column."""
    for c in PUB_COLUMNS:
        if c in df.columns:
            return c
    return None


def age_days(ts, as_of: str) -> Column:
    """Age in (fractional) days at ``as_of``."""
    return F.timestamp_diff("SECOND", _c(ts), F.lit(as_of).cast("timestamp_ntz")) / 86400.0


def recency_score(ts, as_of: str, rate: float = 0.25, missing: float = 0.5) -> Column:
    """exp(-rate * max(0, age days)); ``missing`` when there is no date."""
    a = age_days(ts, as_of)
    return F.when(_c(ts).isNull(), F.lit(missing)).otherwise(F.exp(-rate * F.greatest(F.lit(0.0), a)))


def cutoff(as_of: str, days: int) -> Column:
    """as_of - N days."""
    return F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")


def is_fresh(ts, as_of: str, ttl_seconds: int) -> Column:
    """as_of - ts < TTL."""
    return F.lit(as_of).cast("timestamp_ntz") - _c(ts) < F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS")
