"""Aggregate-expression helpers with engine-independent numerics.

Decimal inputs are summed as decimals (exact) and converted to double once at
the end; a mean is ``double(sum) / count`` so it does not depend on an
engine's decimal-average precision rules.  Quantiles are exact with linear
interpolation (``percentile``), never approximate (Q7).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dsum(c: str | Column) -> Column:
    """Exact sum (decimal or integral double), returned as double."""
    return F.sum(col(c)).cast("double")


def dmean(c: str | Column) -> Column:
    """Mean over non-null values: double(sum) / count."""
    x = col(c)
    return F.sum(x).cast("double") / F.count(x)


def r6(c: Column) -> Column:
    """Round inexact doubles (std, quantiles, ratios) to 6 decimals."""
    return F.round(c, 6)


def q(c: str | Column, p: float) -> Column:
    """Exact quantile, linear interpolation, on the double value."""
    return F.percentile(col(c).cast("double"), p)


def std(c: str | Column) -> Column:
    """Sample standard deviation (pandas ``Series.std``, Q8)."""
    return F.stddev_samp(col(c).cast("double"))


def argmax(key: str, value: Column) -> Column:
    """Key of the greatest value; ties go to the smallest key (Q9)."""
    return F.min_by(F.col(key), F.struct(-value, F.col(key)))


def bround2(c: Column) -> Column:
    """Round half to even at 2 decimals (numpy ``round``)."""
    return F.bround(c, 2)
