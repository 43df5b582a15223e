"""Text column functions (F-10 ... F-15), all built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the source system's): ASCII punctuation removed by the
# question key, and the characters Python treats as whitespace.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WHITESPACE_CLASS = ("[\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
                    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_key(c) -> Column:
    """F-10: lower-case, strip ASCII punctuation, collapse whitespace, trim."""
    low = F.translate(F.lower(_c(c)), PUNCTUATION, "")
    return F.trim(F.regexp_replace(low, WHITESPACE_CLASS, " "))


def singular(c) -> Column:
    """F-11: drop a trailing 's' from words longer than 4 characters (lower-cased)."""
    from martlens.plans.entities import singular as _s
    return _s(_c(c))


def identifier_parts(c) -> tuple[Column, Column]:
    """F-12: (lower prefix, number) of ``^[A-Za-z]{2,4}\\d{1,6}$``, NULLs otherwise."""
    from martlens.plans.entities import ident_number, ident_prefix
    return ident_prefix(_c(c)), ident_number(_c(c))


def figure_tokens(c) -> Column:
    """F-13: number tokens after masking dates (array, in order)."""
    from martlens.plans.claims import DATE_LIKE_RE, NUMBER_RE
    return F.regexp_extract_all(F.regexp_replace(_c(c), DATE_LIKE_RE, " "), F.lit(f"({NUMBER_RE})"), 1)


def identifier_tokens(c) -> Column:
    """F-14: identifier-shaped tokens (array, in order)."""
    from martlens.plans.claims import IDENTIFIER_RE
    return F.regexp_extract_all(_c(c), F.lit(f"({IDENTIFIER_RE})"), 1)


def top_n(c) -> Column:
    """F-15: the N of 'top/bottom/best/worst N' unless a time unit follows (NULL otherwise)."""
    from martlens.plans.verify import top_n_col
    return top_n_col(_c(c))
