"""Rounding as the reports define it: halves go up, towards plus infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column, digits: int = 0) -> Column:
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def round1(c: Column) -> Column:
    return round_half_up(c, 1)


def round2(c: Column) -> Column:
    return round_half_up(c, 2)


def round_int(c: Column) -> Column:
    return F.floor(c + F.lit(0.5)).cast("int")


def trunc(c: Column) -> Column:
    """Towards zero."""
    return c.cast("int")


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
