"""Text expressions: trimming, blanks and case-insensitive patterns."""

import re
from functools import reduce

from pyspark.sql import Column, functions as F


# Every character that counts as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(value: Column) -> Column:
    """Trim every kind of Unicode white space, not blanks alone. One call, so that a row of many fields
    stays within the size of methods that the JVM compiles."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def blank_to_null(value: Column) -> Column:
    return F.nullif(strip(value), F.lit(""))


def first_filled(*values: Column) -> Column:
    """First value that is neither null nor blank, trimmed; '' when there is none."""
    return F.coalesce(*[blank_to_null(v) for v in values], F.lit(""))


def is_filled(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def like_pattern(text: str) -> str:
    """A pattern as users may type it, in the form ``ilike`` accepts.

    ``%`` and ``_`` stay wildcards. A backslash makes the next character literal; before any
    other character than ``%``, ``_`` or a backslash it is dropped, and a last lone one is kept
    as itself.
    """
    text = re.sub(r"(?s)(\\[%_\\])|\\(.)", lambda m: m.group(1) or m.group(2), text)
    trailing = len(text) - len(text.rstrip("\\"))
    return text + "\\" if trailing % 2 else text


def like_pattern_column(pattern: Column) -> Column:
    """``like_pattern`` for patterns held in a column."""
    tidy = F.regexp_replace(pattern, r"(?s)(\\[%_\\])|\\(.)", "$1$2")
    trailing = F.length(tidy) - F.length(F.regexp_replace(tidy, r"\\+$", ""))
    return F.when(trailing % 2 == 1, F.concat(tidy, F.lit("\\"))).otherwise(tidy)


def contains_any(columns: list[Column], text: str) -> Column:
    """True when any column contains ``text``, ignoring case."""
    pattern = like_pattern(f"%{text}%")
    return reduce(lambda a, b: a | b, [c.ilike(pattern) for c in columns])
