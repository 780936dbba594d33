"""Functions on strings and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_term(text: Column, term: str) -> Column:
    """Overlapping exact occurrences of a term within the lines of a text."""
    quoted = "".join(f"\\x{{{ord(c):x}}}" for c in term)
    return F.coalesce(F.regexp_count(text, F.lit(f"(?={quoted})")), F.lit(0)).cast("long")


def before_first(s: Column, c: str) -> Column:
    return F.substring_index(s, c, 1)


def after_last(s: Column, c: str) -> Column:
    return F.substring_index(s, c, -1)


def after_first(s: Column, c: str) -> Column:
    """The whole string where the character is missing."""
    return F.when(F.instr(s, c) > 0, F.substring(s, F.instr(s, c) + 1, F.length(s))).otherwise(s)


def before_last(s: Column, c: str) -> Column:
    return F.when(F.instr(s, c) > 0, F.substring(s, F.lit(1), F.length(s) - F.length(after_last(s, c)) - 1)).otherwise(s)


def leap_year(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def scene_date(s: Column) -> Column:
    """yyyyMMdd, yyyy-MM-dd or yyyy/MM/dd as a date, else null."""
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in ("yyyyMMdd", "yyyy-MM-dd", "yyyy/MM/dd")]).cast("date")
