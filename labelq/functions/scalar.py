"""Column expressions that Spark's built-ins lack. Undefined values are NULL, never NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))  # least() skips NULLs


def share(top: Column, bottom: Column, otherwise: Column | None = None) -> Column:
    """top / bottom, NULL or ``otherwise`` where bottom is 0."""
    q = F.try_divide(top.cast("double"), bottom.cast("double"))
    return q if otherwise is None else F.coalesce(q, otherwise)


def choose2(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def log_factorial(n: Column) -> Column:
    """ln n! for whole n >= 0: Stirling's series at n + 9, stepped down by the product of
    the eight factors between."""
    x = n.cast("double") + 1
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    return series - F.log(reduce(lambda a, k: a * (x + k), range(1, 8), x))


def plogp(c: Column) -> Column:
    return F.when(c > 0, c * F.log(c)).otherwise(F.lit(0.0))


def r6(c: Column | str) -> Column:
    """Six decimals, with no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)
