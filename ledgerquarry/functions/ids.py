"""Canonical identifiers and the digit runs that paperwork quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Empty text counts as no value."""
    return F.when(F.length(F.trim(c)) > 0, c)


def canonical_id(c: Column) -> Column:
    """Upper case, letters A-Z and digits only; null for null, '' where nothing is left."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def digit_runs(c: Column, n: int) -> Column:
    """Every number of exactly ``n`` digits in the text, a blank allowed between digits, blanks removed.

    Null text gives an empty array; a longer run of digits is not a match; repeats are listed once, in order.
    """
    pattern = rf"((?<!\d)\d(?:[\s ]?\d){{{n - 1}}}(?!\d))"
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[^0-9]", "")))
