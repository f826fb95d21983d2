"""Column functions that operators share, all of them built from Spark's own."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Safe zone in percentiles.
LO, HI = 12, 86
#: Standard normal quantiles of 1 to 99 percent, which Spark has no function for.
Z = [round(NormalDist().inv_cdf(i / 100), 9) for i in range(1, 100)]


def mse(actual: Column, recon: Column) -> Column:
    """Mean squared error of two arrays of one length."""
    total = F.aggregate(F.zip_with(actual, recon, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return total / F.size(actual)


def quantile_at(q: Column, pct: Column) -> Column:
    """The value at a percentile (0 to 100) of a vector of 101 quantiles, linear between them."""
    i = F.least(F.floor(pct), F.lit(99)).cast("int")
    low, high = F.get(q, i), F.get(q, i + 1)
    return low + (pct - i) * (high - low)


def percentile_of(q: Column, x: Column, n: Column) -> Column:
    """The percentile of x, n being the number of quantiles not over it: 0 under the least, 100 from the greatest on, else linear within its bin."""
    i = F.least(F.greatest(n - 1, F.lit(0)), F.lit(99))
    low, high = F.get(q, i), F.get(q, i + 1)
    inside = i + (x - low) / F.when(high > low, high - low)
    return F.when(n == 0, 0.0).when(n > 100, 100.0).otherwise(inside)


def channel(pct: Column, lo: float | Column = LO, hi: float | Column = HI) -> Column:
    """anomaly_high over the zone, anomaly_low under it, micro inside, edges included; none for a null.  The edges may be columns."""
    return F.when(pct > hi, "anomaly_high").when(pct < lo, "anomaly_low").when(pct.isNotNull(), "micro")


def ms(x: Column) -> Column:
    """Seconds as whole milliseconds, so that running sums are exact."""
    return F.round(x * 1000).cast("bigint")
