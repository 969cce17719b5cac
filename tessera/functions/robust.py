"""Order statistics of arrays, each by its own definition: they differ, and must not be taken for each other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_median(values: Column) -> Column:
    """sorted[n / 2], the upper of two middles."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def averaged_median(values: Column) -> Column:
    """The mean of the two middles of an even number."""
    n, s = F.size(values), F.sort_array(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0


def deviation(values: Column, centre: Column) -> Column:
    """The upper median of absolute deviations from centre."""
    return upper_median(F.transform(values, lambda v: F.abs(v - centre)))


def at_share(values: Column, share: float) -> Column:
    """sorted[floor((n - 1) * share)]."""
    return F.get(F.sort_array(values), F.floor((F.size(values) - 1) * F.lit(share)).cast("int"))


def at_thousandths(values: Column, thousandths: int) -> Column:
    """sorted[n * thousandths / 1000], in whole numbers."""
    return F.get(F.sort_array(values), F.floor(F.size(values) * thousandths / 1000).cast("int"))


def at_rank(values: Column, share: float) -> Column:
    """sorted[ceil(n * share) - 1]."""
    return F.get(F.sort_array(values), (F.ceil(F.size(values) * F.lit(share)) - 1).cast("int"))


def trimmed_mean(values: Column, share: float) -> Column:
    """The mean after floor(n * share), n / 3 at most, has gone from both ends."""
    n = F.size(values)
    cut = F.least(F.floor(n * F.lit(share)), F.floor(n / 3)).cast("int")
    kept = F.slice(F.sort_array(values), cut + 1, n - 2 * cut)
    return F.aggregate(kept, F.lit(0.0), lambda a, v: a + v) / F.size(kept)
