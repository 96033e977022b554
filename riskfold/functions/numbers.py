"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the first-number pattern of the reference.  The sign binds only
# to the decimal branch, so "-5" -> 5 and "-0.5%" -> -0.5; "1,234.5" -> 1.
FIRST_NUMBER_PATTERN = r"[-+]?\d*\.\d+|\d+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract_number(c) -> Column:
    """First number inside a string, null when there is none."""
    m = F.regexp_extract(_c(c).cast("string"), FIRST_NUMBER_PATTERN, 0)
    return F.when(m == "", F.lit(None).cast("double")).otherwise(m.try_cast("double"))


def round_money(c, digits: int = 2) -> Column:
    """Half-up rounding of a money amount through a fixed-scale decimal, so a
    decimal tie (e.g. 1002220.055) rounds the same on every engine."""
    return F.round(_c(c).cast("decimal(38,6)"), digits).cast("double")


def ratio_scale(c, limit: float = 3.0) -> Column:
    """M2: a ratio whose magnitude exceeds ``limit`` is taken as a percent."""
    c = _c(c).cast("double")
    return F.when(F.abs(c) > limit, c / 100.0).otherwise(c)


def safe_div(n, d) -> Column:
    """M3: null when numerator is null or divisor is 0/null."""
    return F.try_divide(_c(n).cast("double"), F.nullif(_c(d).cast("double"), F.lit(0.0)))


def pick_or_derive(picked, derived) -> Column:
    """M5: a picked value of 0 counts as missing (truthiness fall-back)."""
    p = _c(picked).cast("double")
    return F.coalesce(F.nullif(p, F.lit(0.0)), _c(derived))


def clip(c, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(c)))


def _dec(c, digits: int) -> Column:
    # Decimal (half-up) rounding before printf-style formatting, so ties such
    # as 0.25 -> "0.3" do not depend on the engine's binary rounding (Q30).
    return F.round(_c(c).cast("double").try_cast("decimal(38,6)"), digits).cast("double")


def fmt_metric(c, percent: bool = False) -> Column:
    """human readable number: N/A, percent (1 decimal), $B, $M, 2 decimals."""
    x = _c(c).cast("double")
    if percent:
        body = F.format_string("%.1f%%", _dec(x * 100.0, 1))
    else:
        body = (F.when(F.abs(x) >= 1e9, F.format_string("$%.1fB", _dec(x / 1e9, 1)))
                .when(F.abs(x) >= 1e6, F.format_string("$%.1fM", _dec(x / 1e6, 1)))
                .otherwise(F.format_string("%.2f", _dec(x, 2))))
    return F.when(x.isNull(), F.lit("N/A")).otherwise(body)


def fmt_fixed(c, decimals: int = 2) -> Column:
    """fixed decimals (half-up)."""
    return F.format_string(f"%.{decimals}f", _dec(c, decimals))


def fmt_percent(c, decimals: int = 1) -> Column:
    """percent text of a ratio."""
    return F.format_string(f"%.{decimals}f%%", _dec(_c(c).cast("double") * 100.0, decimals))


def fmt_thousands(c) -> Column:
    """integer with thousands separators (e.g. 1,234,567)."""
    return F.format_string("%,d", F.round(_c(c).cast("double"), 0).cast("long"))
