"""Window specifications and null-safe expressions that the operators share.

Panels are long: one row for each (ts, asset). ``along`` looks along time within an asset, ``across``
looks across assets at one time. Missing values are NULL, never NaN. Divisions that could meet a
zero use ``try_divide``, because ANSI mode raises on them.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window


def along(asset: str = "asset", ts: str = "ts") -> WindowSpec:
    return Window.partitionBy(asset).orderBy(ts)


def trailing(n: int, asset: str = "asset", ts: str = "ts", lag: int = 0) -> WindowSpec:
    """The last n rows of the asset, ending ``lag`` rows before the current one."""
    return along(asset, ts).rowsBetween(-(n - 1) - lag, -lag)


def so_far(asset: str = "asset", ts: str = "ts") -> WindowSpec:
    return along(asset, ts).rowsBetween(Window.unboundedPreceding, 0)


def across(ts: str = "ts") -> WindowSpec:
    return Window.partitionBy(ts)


def finite(x: Column) -> Column:
    """NULL instead of NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ln(x: Column) -> Column:
    """Natural logarithm of positive values; NULL for the rest."""
    return F.when(x > 0, F.log(x))


def full(agg: Column, x: Column, n: int, w: WindowSpec) -> Column:
    """``agg`` where all n rows of the frame have a value; like a rolling window of n observations."""
    return F.when(F.count(x).over(w) == n, agg.over(w))


def at_least(agg: Column, x: Column, n: int, w: WindowSpec) -> Column:
    return F.when(F.count(x).over(w) >= n, agg.over(w))


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))


def both(x: Column, y: Column) -> tuple[Column, Column]:
    """The two values where both are there."""
    ok = x.isNotNull() & y.isNotNull()
    return F.when(ok, x), F.when(ok, y)


def correlation(x: Column, y: Column, w: WindowSpec | None = None) -> Column:
    """Pearson correlation over pairs of values; NULL where one side is constant."""
    x, y = both(x, y)
    over = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    spread = over(F.stddev_samp(x)) * over(F.stddev_samp(y))
    return F.when(spread > 1e-15, F.try_divide(over(F.covar_samp(x, y)), spread))


def slope(y: Column, x: Column, w: WindowSpec | None = None) -> Column:
    """Covariance over variance of x; NULL where x is constant."""
    x, y = both(x, y)
    over = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    var = over(F.var_samp(x))
    return F.when(var > 0, F.try_divide(over(F.covar_samp(x, y)), var))


def average_rank(x: Column, *partition: str) -> Column:
    """Rank from 1 among the non-null values of the partition, ties at their mean rank."""
    within = Window.partitionBy(*partition)
    ties = Window.partitionBy(*partition, x)
    return F.when(x.isNotNull(), F.rank().over(within.orderBy(x.asc_nulls_last())) + (F.count(x).over(ties) - 1) / F.lit(2.0))


def percent_rank_average(x: Column, *partition: str) -> Column:
    """Average rank over the number of non-null values, as in a percentage rank."""
    return average_rank(x, *partition) / F.count(x).over(Window.partitionBy(*partition))


def unbiased_skewness(x: Column) -> Column:
    """Sample skewness with the usual correction; NULL below three values or without spread."""
    n = F.count(x).cast("double")
    return F.when((n >= 3) & (F.stddev_pop(x) > 0), F.try_divide(F.skewness(x) * F.sqrt(n * (n - 1)), n - 2))


def unbiased_excess_kurtosis(x: Column) -> Column:
    n = F.count(x).cast("double")
    k = F.kurtosis(x)  # excess, of the population
    return F.when((n >= 4) & (F.stddev_pop(x) > 0), F.try_divide((n - 1), (n - 2) * (n - 3)) * ((n + 1) * k + 6))
