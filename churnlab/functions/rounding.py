"""Exact rounding of means of whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up_mean_2dp(total: Column, count: Column) -> Column:
    """``round(total / count, 2)`` with ties rounded up, computed on integers.

    ``(200 * total + count) div (2 * count) / 100`` is exact integer division for
    non-negative totals while ``200 * total + count < 2**63``, so
    engines that round doubles differently (half-even vs half-up on an
    inexact binary value) still agree.  Null when ``count`` is 0.
    """
    t = total.cast("bigint")
    n = count.cast("bigint")
    scaled = F.call_function("div", F.lit(200) * t + n, F.lit(2) * n)
    return F.when(n > 0, scaled / F.lit(100)).cast("double")


UNITS = 1_000_000


def units(x: Column) -> Column:
    """A double as a whole number of millionths (one multiplication and one rounding, the
    same in every engine), so that sums don't depend on the order of the rows."""
    return F.round(x * F.lit(float(UNITS))).cast("decimal(38,0)")


def half_up_mean_units(total: Column, count: Column) -> Column:
    """``round(mean, 2)`` with ties away from zero, computed on integers, of ``count`` values
    whose :func:`units` add up to ``total``.  Null when ``count`` is 0 or null."""
    t, n = total.cast("decimal(38,0)"), count.cast("decimal(20,0)")
    scaled = F.call_function("div", F.abs(t) * F.lit(200) + n * F.lit(UNITS), n * F.lit(2 * UNITS))
    return F.when(n > 0, F.when(t < 0, -scaled).otherwise(scaled) / F.lit(100)).cast("double")
