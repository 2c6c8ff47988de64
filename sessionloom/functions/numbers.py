"""Rounding, shares and counting expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 when the whole is not positive."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def round_to(value: Column, digits: int) -> Column:
    """Half-up rounding done in plain double arithmetic."""
    scale = F.lit(float(10**digits))
    return F.floor(value * scale + F.lit(0.5)).cast("double") / scale


def ratio4(part: Column, whole: Column) -> Column:
    return round_to(ratio(part, whole), 4)


def percent_share(part: Column, whole: Column) -> Column:
    """Share of a total in percent, 0 when the total is 0."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double") * F.lit(100.0)).otherwise(F.lit(0.0))


def count_true(flag: Column) -> Column:
    return F.count(F.when(flag, F.lit(1)))


def or_unknown(col: Column) -> Column:
    """Blank or null becomes ``(unknown)``."""
    trimmed = F.trim(col)
    return F.when(col.isNull() | (trimmed == ""), F.lit("(unknown)")).otherwise(trimmed)
