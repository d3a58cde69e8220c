"""Lenient conversions for metric files written by many tools."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quorumql.functions.text import strip

# Text that reads as a floating-point number; rules out forms such as '3d' that a cast would take.
_FLOAT_TEXT = r"(?i)\A\s*[+-]?(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:e[+-]?\d+)?\s*\z"


def to_float(text: Column) -> Column:
    """Number in ``text``; blank or malformed gives null."""
    value = text.cast("string")
    digits = F.replace(strip(value), F.lit("_"), F.lit(""))
    return F.when(value.rlike(_FLOAT_TEXT), digits.try_cast("double"))


def to_int(text: Column) -> Column:
    """Whole part of the number in ``text`` (towards zero); blank or malformed gives null."""
    return to_float(text).try_cast("bigint")


def iso_seconds(started: Column, finished: Column) -> Column:
    """Seconds between two ISO timestamps; null when either is missing or malformed."""
    begin, end = F.try_to_timestamp(started), F.try_to_timestamp(finished)
    return (F.unix_micros(end) - F.unix_micros(begin)) / F.lit(1_000_000.0)
