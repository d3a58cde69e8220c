"""Whitespace handling with the Unicode definition of a blank."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# (?U) gives the Unicode White_Space class; the four separators below it are blanks as well.
BLANK = r"[\s\x1c-\x1f]"
_LEADING = rf"(?U)\A{BLANK}+"
_TRAILING = rf"(?U){BLANK}+\z"
_RUNS = rf"(?U){BLANK}+"


def strip(text: Column) -> Column:
    """Drop blanks of every kind (tabs, newlines, no-break spaces) at both ends; ``trim`` only drops spaces."""
    return F.regexp_replace(F.regexp_replace(text, _LEADING, ""), _TRAILING, "")


def squeeze(text: Column) -> Column:
    """Turn every run of blanks into one space and drop those at the ends."""
    return F.trim(F.regexp_replace(text, _RUNS, " "))


def clip(text: Column, max_len: int, keep: int | None = None) -> Column:
    """Cut text longer than ``max_len`` to its first ``keep`` characters (default: all of max_len) plus ``...``."""
    kept = max_len if keep is None else keep
    return F.when(F.length(text) > max_len, F.concat(F.substring(text, 1, kept), F.lit("..."))).otherwise(text)
