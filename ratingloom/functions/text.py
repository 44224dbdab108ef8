"""Text column expressions on JVM regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ratingloom.functions.numeric import column

# fixed values: the characters that count as whitespace
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# a run that is not one plain space already
_RUN = f"[{WHITESPACE.replace(' ', '')}][{WHITESPACE}]*| [{WHITESPACE}]+"


def strip(value: Column | str) -> Column:
    """Remove leading and trailing whitespace of every kind, not only spaces."""
    return F.btrim(column(value), F.lit(WHITESPACE))


def normalize_text(value: Column | str) -> Column:
    """Strip, squeeze inner whitespace runs to one space, upper-case.

    The value stands in the expression once: filters and joins that are pushed below it copy what it is made of, and each
    further mention would multiply with the mentions inside.
    """
    return F.upper(F.regexp_replace(strip(value), _RUN, " "))


def category_key(value: Column | str) -> Column:
    """Upper-case letters and digits, every other run as one space."""
    return F.trim(F.regexp_replace(F.upper(column(value)), "[^A-Z0-9]+", " "))


def leading_letters(value: Column | str) -> Column:
    """The run of capitals at the start, null without one."""
    return F.nullif(F.regexp_extract(column(value), "^([A-Z]+)", 1), F.lit(""))


def trailing_number(value: Column | str, default: int | None = 0) -> Column:
    """The digits at the end as a number, ``default`` without them or beyond the integer range."""
    number = F.regexp_extract(column(value), r"(\d+)$", 1).try_cast("int")
    return number if default is None else F.coalesce(number, F.lit(default))


def contains_literal(names: list[str], text: str) -> Column:
    """Case-insensitive literal substring in any of the named columns; null holds no text."""
    needle = F.lower(F.lit(text))
    hit = F.lit(False)
    for name in names:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(name).cast("string"), F.lit(""))), needle)
    return hit


def joined_label(*names: str, separator: str = " — ") -> Column:
    """Columns joined by a separator; null if any part is null."""
    parts: list[Column] = []
    for name in names:
        parts += ([F.lit(separator)] if parts else []) + [F.col(name)]
    return F.concat(*parts)


def title_label(value: Column | str) -> Column:
    """``some_label`` as ``Some Label``."""
    return F.initcap(F.replace(column(value), F.lit("_"), F.lit(" ")))


def decode(value: Column | str, labels: dict[str, str]) -> Column:
    """Code to label through a literal map; an unknown code gives null."""
    pairs = [F.lit(part) for pair in labels.items() for part in pair]
    return F.create_map(*pairs)[column(value)]


def decode_or_raise(value: Column | str, key: Column, labels: dict[str, str], what: str) -> Column:
    """Like ``decode`` on ``key``, but an unknown or null value fails the job and names the value."""
    shown = F.coalesce(column(value).cast("string"), F.lit("null"))
    return F.coalesce(decode(key, labels), F.raise_error(F.concat(F.lit(f"Unmapped {what}: "), shown)))
