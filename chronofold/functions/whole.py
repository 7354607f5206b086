"""Sums of seconds in whole milliseconds, and rounding in whole numbers: the same in any order, with halves that are halves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total_ms(seconds: Column) -> Column:
    """The sum of seconds in milliseconds; what is no number counts 0."""
    return F.sum(F.coalesce(F.round(seconds * 1000).try_cast("long"), F.lit(0).cast("long")))


def in_units(ms: Column, unit: int, even: bool = False) -> Column:
    """ms / unit as a whole number, halves up, or to even."""
    rest = F.pmod(ms, F.lit(unit))
    below = F.call_function("div", ms - rest, F.lit(unit))
    half = (rest * 2 == unit) & (below % 2 != 0 if even else F.lit(True))
    return below + F.when((rest * 2 > unit) | half, 1).otherwise(0)
