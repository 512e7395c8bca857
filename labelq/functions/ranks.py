"""Exact ranks and quantiles without a global sort in one task.

Rows are first counted by value, so that ties cost one row; distinct values are dealt
to buckets between approximate quantiles, and ranks are a prefix sum over buckets plus
one within. The approximation decides the buckets' sizes and never a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def cumulative(df: DataFrame, by: list[str], value: str, weights: dict[str, Column] | None = None) -> DataFrame:
    """(by..., value, n, before): rows of each distinct value, and rows of smaller ones in the
    group. ``weights`` adds sums of further columns over the rows of the value. NULLs are left out."""
    more = weights or {}
    v = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in more.items()))
    return accumulate(v, by, value)


def accumulate(v: DataFrame, by: list[str], value: str) -> DataFrame:
    """As cumulative(), from rows (by..., value, n) of distinct values."""
    cuts = F.percentile_approx(value, [k / BUCKETS for k in range(1, BUCKETS)], 1000).alias("cuts")
    bounds = v.groupBy(*by).agg(cuts)
    placed = (v.join(bounds, by) if by else v.crossJoin(bounds)).withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")
    sums = placed.groupBy(*by, "bucket").agg(F.sum("n").alias("rows"))
    earlier = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "bucket", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*by, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(sums, [*by, "bucket"]).withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("base", "bucket")


def quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """(by..., one column for each of ``probs``) with linear interpolation between order statistics."""
    c = cumulative(df, by, value)
    totals = c.groupBy(*by).agg(F.sum("n").alias("total"))
    c = c.join(totals, by) if by else c.crossJoin(totals)

    def at(k: Column) -> Column:
        return F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col(value).cast("double")))

    def one(p: float) -> Column:
        h = F.lit(float(p)) * (F.col("total") - 1)
        low, high = at(F.floor(h)), at(F.ceil(h))
        return low + (high - low) * F.max(h - F.floor(h))

    return c.groupBy(*by).agg(*(one(p).alias(k) for k, p in probs.items()))


def kth_smallest(df: DataFrame, by: list[str], value: str, k: Column, alias: str = "kth") -> DataFrame:
    """(by..., alias, rows): the k-th smallest value of each group; ``k`` may use ``total``, the group's rows."""
    c = cumulative(df, by, value)
    totals = c.groupBy(*by).agg(F.sum("n").alias("total"))
    c = c.join(totals, by) if by else c.crossJoin(totals)
    hit = (F.col("before") < k) & (k <= F.col("before") + F.col("n"))
    return c.groupBy(*by).agg(F.max(F.when(hit, F.col(value))).alias(alias), F.max("total").alias("rows"))


def column_quantiles(df: DataFrame, probs: dict[str, tuple[str, float]]) -> DataFrame:
    """One row with a quantile of each named column, {name: (column, p)}, from one pass: the
    columns are stacked and ranked side by side."""
    columns = sorted({c for c, _ in probs.values()})
    stack = F.explode(F.array(*(F.struct(F.lit(c).alias("which"), F.col(c).cast("double").alias("x")) for c in columns)))
    levels = sorted({p for _, p in probs.values()})
    q = quantiles(df.select(stack.alias("s")).select("s.*"), ["which"], "x", {f"q{k}": p for k, p in enumerate(levels)})
    return q.agg(*(F.max(F.when(F.col("which") == c, F.col(f"q{levels.index(p)}"))).alias(name) for name, (c, p) in probs.items()))
