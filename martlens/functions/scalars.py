"""Scalar column functions (F-01 ... F-09, F-16 ... F-18).

All are built-in Spark expressions, so they stay inside whole-stage codegen.
Spark 4 runs in ANSI mode: division by zero and bad casts raise, which is why
every ratio here goes through :func:`safe_ratio` / :func:`safe_pct_change` and
every parse through a ``try_`` function.
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit_date(d: date | str) -> Column:
    return F.lit(d if isinstance(d, date) else date.fromisoformat(d))


# --- F-01 ... F-04: month arithmetic ---------------------------------------
def month_key_of(d: ColumnOrName) -> Column:
    """'YYYY-MM' of a date or timestamp column (F-01)."""
    return F.date_format(_c(d), "yyyy-MM")


def shift_months(d: ColumnOrName, n: int) -> Column:
    """First day of the month n months away (F-02)."""
    return F.add_months(F.trunc(_c(d), "MM"), n)


def month_keys_between(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Array of month keys from a's month to b's month inclusive (F-03)."""
    seq = F.sequence(F.trunc(_c(a), "MM"), F.trunc(_c(b), "MM"), F.expr("interval 1 month"))
    return F.transform(seq, lambda m: F.date_format(m, "yyyy-MM"))


def months_in_window(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Number of calendar months touched by [a, b], at least 1 (F-04)."""
    n = F.months_between(F.trunc(_c(b), "MM"), F.trunc(_c(a), "MM")).cast("int") + 1
    return F.greatest(F.lit(1), n)


# --- F-05 ... F-07: zero-safe arithmetic -----------------------------------
def as_double(x: ColumnOrName) -> Column:
    return _c(x).cast("double")


def safe_ratio(n: ColumnOrName, d: ColumnOrName) -> Column:
    """n / d in double, 0.0 when d is zero (F-06). NULL inputs stay NULL."""
    num, den = as_double(n), as_double(d)
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def safe_pct_change(old: ColumnOrName, new: ColumnOrName) -> Column:
    """(new - old) / old * 100 in double, 0.0 on a zero base (F-05)."""
    o, n = as_double(old), as_double(new)
    return F.when(o == 0, F.lit(0.0)).otherwise((n - o) / o * 100.0)


def percentage(part: ColumnOrName, whole: ColumnOrName, digits: int = 4) -> Column:
    """part / whole * 100 rounded, 0.0 on a zero whole (F-07).

    Counts are integers, so the rounding is done exactly (half-up), which gives
    bit-identical results in any engine. The products are 38-digit decimals: a
    long overflows at 100 TB of cents.
    """
    p, w = _c(part).cast("decimal(20,0)"), _c(whole).cast("decimal(20,0)")
    scale = F.lit(Decimal(2 * 10 ** (digits + 2)))
    rounded = F.call_function("div", (p * scale).cast("decimal(38,0)") + w, w * F.lit(Decimal(2)))
    return F.when(w == 0, F.lit(0.0)).otherwise(rounded.cast("double") / float(10 ** digits))


def pct_of(part: ColumnOrName, whole: ColumnOrName) -> Column:
    """Unrounded 100 * part / whole in double, 0.0 on a zero whole."""
    p, w = as_double(part), as_double(whole)
    return F.when(w == 0, F.lit(0.0)).otherwise(p * 100.0 / w)


# --- F-08: calendar attributes --------------------------------------------
def day_name(d: ColumnOrName) -> Column:
    return F.date_format(_c(d), "EEEE")


def is_weekend_flag(d: ColumnOrName) -> Column:
    # Spark dayofweek: Sunday=1 ... Saturday=7
    return F.dayofweek(_c(d)).isin(1, 7).cast("int")


def day_type(d: ColumnOrName) -> Column:
    return F.when(F.dayofweek(_c(d)).isin(1, 7), F.lit("Weekend")).otherwise(F.lit("Weekday"))


def festive_period(d: ColumnOrName, periods, non_festive: str = "Normal") -> Column:
    """Label of the festive window containing the date, by month-day rule."""
    md = F.date_format(_c(d), "MM-dd")
    expr = None
    for p in periods:
        if p.start_mmdd <= p.end_mmdd:
            cond = (md >= F.lit(p.start_mmdd)) & (md <= F.lit(p.end_mmdd))
        else:  # wraps over the year end
            cond = (md >= F.lit(p.start_mmdd)) | (md <= F.lit(p.end_mmdd))
        expr = F.when(cond, F.lit(p.name)) if expr is None else expr.when(cond, F.lit(p.name))
    return F.lit(non_festive) if expr is None else expr.otherwise(F.lit(non_festive))


# --- F-09: date-like parser -------------------------------------------------
ISO_DATE_RE = r"^\d{4}-\d{2}-\d{2}$"
MONTH_KEY_RE = r"^\d{4}-\d{2}$"


def parse_date_like(s: ColumnOrName) -> Column:
    """'YYYY-MM-DD' -> date, 'YYYY-MM' -> first of month, anything else NULL."""
    c = F.trim(_c(s).cast("string"))
    return (F.when(c.rlike(ISO_DATE_RE), F.try_to_date(c, "yyyy-MM-dd"))
            .when(c.rlike(MONTH_KEY_RE), F.try_to_date(F.concat(c, F.lit("-01")), "yyyy-MM-dd")))


# --- F-16 ... F-18 ------------------------------------------------------------
def abs_deviation(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.abs(_c(a) - _c(b))


def money(x: ColumnOrName) -> Column:
    """Exact money type: DECIMAL(18,2) (sums stay exact and order-independent)."""
    return _c(x).cast("decimal(18,2)")


def round_money(x: ColumnOrName) -> Column:
    """Round a decimal product back to cents (half-up on the exact value)."""
    return F.round(_c(x), 2).cast("decimal(18,2)")


def dec(v: str | float | int) -> Column:
    return F.lit(Decimal(str(v)))


def zero_if_null(x: ColumnOrName) -> Column:
    return F.coalesce(_c(x), F.lit(0))
