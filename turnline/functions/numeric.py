"""Ratios, means and correlations computed from integer totals.

Rounding happens on integers, half away from zero, so a percentage that falls on
a tie comes out as an exact decimal would, whatever the order rows were summed in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(dividend: Column, divisor: Column) -> Column:
    return F.call_function("div", dividend, divisor)


def count_rows() -> Column:
    return F.count(F.lit(1))


def ratio(numerator: Column, denominator: Column, scale: int) -> Column:
    """``numerator / denominator`` to ``1 / scale``, null when the denominator is 0.

    Both are whole numbers; the denominator is never negative.
    """
    n = F.nullif(denominator.cast("bigint"), F.lit(0).cast("bigint"))
    k = numerator.cast("bigint")
    rounded = int_div(F.abs(k) * F.lit(2 * scale).cast("bigint") + n, n * 2)
    return F.when(k < 0, -rounded).otherwise(rounded) / F.lit(float(scale))


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    return ratio(part * 100, whole, 10**digits)


def mean(total: Column, n: Column, digits: int = 2) -> Column:
    return ratio(total, n, 10**digits)


def mean_of(value: Column, digits: int = 2) -> Column:
    """Aggregate: the mean of a whole-number column over its non-null rows."""
    return mean(F.sum(value), F.count(value), digits)


def pct_of_rows(predicate: Column, digits: int = 2) -> Column:
    """Aggregate: share of all rows on which the predicate is true; null counts as false."""
    return pct(F.count_if(predicate), count_rows(), digits)


def correlation(x: Column, y: Column, where: Column | None = None) -> Column:
    """Aggregate: Pearson correlation of two whole-number columns, null at zero variance.

    Only rows with both values count.  The moments are exact integers, so the
    result does not depend on how rows were partitioned or in which order they met.
    """
    both = x.isNotNull() & y.isNotNull()
    if where is not None:
        both = both & where
    x = F.when(both, x).cast("bigint")
    y = F.when(both, y).cast("bigint")

    def total(value: Column) -> Column:
        return F.sum(value).cast("decimal(19,0)")

    n = F.count(x).cast("decimal(19,0)")
    sx, sy = total(x), total(y)
    cross = (n * total(x * y) - sx * sy).cast("double")
    spread_x = (n * total(x * x) - sx * sx).cast("double")
    spread_y = (n * total(y * y) - sy * sy).cast("double")
    return cross / F.nullif(F.sqrt(spread_x) * F.sqrt(spread_y), F.lit(0.0))
