"""Statistics with a stated answer where the textbook one is undefined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(condition: Column) -> Column:
    """Share of rows with the condition, among those where it is known."""
    return F.avg(F.when(condition, 1.0).when(~condition, 0.0))


def quantile(c: Column | str, p: float) -> Column:
    """Exact, linear between neighbours."""
    return F.percentile(c, F.lit(p))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's r; null where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def empirical_p(null_stat: Column, observed: Column) -> Column:
    """One-sided (r + 1) / (k + 1): never 0."""
    return (F.sum(F.when(null_stat >= observed, 1.0).otherwise(0.0)) + 1.0) / (F.count(null_stat) + 1.0)


def effective_count(names: Sequence[str], r: dict[tuple[str, str], Column]) -> Column:
    """n squared over the sum of absolute correlations, at most n; a constant layer correlates with nothing but itself."""
    n = len(names)
    total = F.lit(float(n))
    for i, a in enumerate(names):
        for b in names[:i]:
            total = total + 2.0 * F.abs(F.coalesce(r[b, a], F.lit(0.0)))
    return F.least(F.lit(float(n)), F.lit(float(n * n)) / total)


def combined(indicators: Sequence[Column], effective: Column) -> Column:
    """Mean of the indicators times effective over named layers."""
    n = float(len(indicators))
    return sum(indicators[1:], indicators[0]) / n * (effective / n)
