"""Aggregate expressions: exact quantiles, lower medians, skewness, guarded correlation, fences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def median(c: str | Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def quantiles(c: str | Column, at: Sequence[float]) -> Column:
    """One pass for all: an array."""
    return F.percentile(c, F.array(*map(F.lit, at)))


def lower_median(name: str) -> Column:
    """The observed value at or below the middle, as int."""
    return F.expr(f"cast(percentile_disc(0.5) WITHIN GROUP (ORDER BY {name}) AS int)")


def skew_adjusted(c: str | Column) -> Column:
    """Bias-adjusted; null below three values or without spread."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.try_subtract(n, F.lit(2.0)))


def corr(a: str | Column, b: str | Column) -> Column:
    """Pearson over rows where both are known; null without spread (the builtin throws there under ANSI)."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a.cast("double"), b.cast("double")), F.stddev_pop(a) * F.stddev_pop(b))


def fences(q1: Column, q3: Column, width: float = 1.5) -> tuple[Column, Column]:
    return q1 - width * (q3 - q1), q3 + width * (q3 - q1)


def finite(c: Column) -> Column:
    """Infinities and NaN as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
