"""Split-conformal label sets from class probabilities in long form: (cell_id, class, p)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelq.functions.ranks import kth_smallest
from labelq.functions.scalar import share

#: Calibration cells that a class needs for a threshold of its own.
LEAST_CELLS = 10


def calibration_scores(proba: DataFrame, truth: DataFrame) -> DataFrame:
    """(class, score): 1 - p of the true class of each calibration cell; truth: (cell_id, label).
    A label that is no class is an error."""
    known = proba.select(F.col("class").alias("label")).distinct()
    if truth.join(known, "label", "left_anti").limit(1).count():
        raise KeyError("a calibration label is not among the classes")
    j = truth.join(proba.withColumnRenamed("class", "label"), ["cell_id", "label"])
    return j.select(F.col("label").alias("class"), (F.lit(1.0) - F.col("p")).alias("score"))


def _threshold(scores: DataFrame, by: list[str], alpha: float) -> DataFrame:
    # the order statistic that quantile(level, method='higher') picks: one above ceil((n + 1)(1 - alpha)), or the last
    rank = F.least(F.ceil((F.col("total") + 1) * F.lit(1.0 - alpha)) + 1, F.col("total"))
    return kth_smallest(scores, by, "score", rank, "qhat")


def thresholds(scores: DataFrame, classes: DataFrame, alpha: float = 0.1, class_conditional: bool = False) -> DataFrame:
    """(class, qhat) for all classes; without calibration cells qhat is 1, which lets all in."""
    whole = _threshold(scores, [], alpha).select(F.coalesce("qhat", F.lit(1.0)).alias("qhat"))
    out = classes.select("class").distinct().crossJoin(whole)
    if class_conditional:
        own = _threshold(scores, ["class"], alpha).where(F.col("rows") >= LEAST_CELLS).select("class", F.col("qhat").alias("own"))
        out = out.join(own, "class", "left").select("class", F.coalesce("own", "qhat").alias("qhat"))
    return out


def prediction_sets(proba_query: DataFrame, proba_cal: DataFrame, truth_cal: DataFrame, alpha: float = 0.1, class_conditional: bool = False, hierarchy: DataFrame | None = None) -> DataFrame:
    """(cell_id, labels, set_size) and, with a hierarchy (leaf, parent), parents: the distinct
    parents of the set, a label without one being its own."""
    t = thresholds(calibration_scores(proba_cal, truth_cal), proba_query, alpha, class_conditional)
    q = proba_query.join(t, "class").withColumn("inside", F.col("p") >= 1.0 - F.col("qhat"))
    if hierarchy is not None:
        q = q.join(hierarchy.withColumnRenamed("leaf", "class"), "class", "left").withColumn("parent", F.coalesce("parent", "class"))
    parts = [F.sort_array(F.collect_list(F.when(F.col("inside"), F.col("class")))).alias("labels")]
    if hierarchy is not None:
        parts.append(F.sort_array(F.collect_set(F.when(F.col("inside"), F.col("parent")))).alias("parents"))
    return q.groupBy("cell_id").agg(*parts).withColumn("set_size", F.size("labels"))


def set_summary(sets: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """One row: mean_set_size, shares of singletons, ambiguous and empty sets; of the ambiguous
    those with one parent; and, with truth (cell_id, label), coverage."""
    n = F.col("set_size")
    rate = lambda c: F.avg(c.cast("double"))
    cols = [F.avg(n).alias("mean_set_size"), rate(n == 1).alias("pct_singleton"), rate(n > 1).alias("pct_ambiguous"), rate(n == 0).alias("pct_empty_novel")]
    if "parents" in sets.columns:
        cols.append((F.sum(((n > 1) & (F.size("parents") == 1)).cast("long")) / F.greatest(F.sum((n > 1).cast("long")), F.lit(1))).alias("pct_ambiguous_one_parent"))
    if truth is not None:
        sets = sets.join(truth.select("cell_id", "label"), "cell_id")
        cols.append(rate(F.array_contains("labels", F.col("label"))).alias("coverage"))
    return sets.agg(*cols)


def coverage_per_type(sets: DataFrame, truth: DataFrame) -> DataFrame:
    """(label, n, coverage)."""
    return sets.join(truth.select("cell_id", "label"), "cell_id").groupBy("label").agg(F.count("*").alias("n"), share(F.sum(F.array_contains("labels", F.col("label")).cast("long")), F.count("*")).alias("coverage"))


def level_rank(n: int, alpha: float) -> int:
    """The rank that thresholds() uses, for tests."""
    return min(math.ceil((n + 1) * (1 - alpha)) + 1, n)
