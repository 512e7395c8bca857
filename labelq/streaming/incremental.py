"""Metrics whose state is a few sums, over streams of labelled or counted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelq.operators.agreement import contingency


def streaming_contingency(rows: DataFrame, truth: str, pred: str, time: str | None = None, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The contingency table of a stream, in all or in windows of event time; every score of
    labelq.operators.agreement is a batch plan over what this writes."""
    if time is None:
        return contingency(rows, truth, pred)
    nan = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    w = F.window(time, width)
    return rows.withWatermark(time, late).groupBy(w.alias("window"), nan(truth).alias("truth"), nan(pred).alias("pred")).agg(F.count("*").alias("n"))


def streaming_signal(rows: DataFrame, time: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per window and cell: total, detected entries and the sum behind the entropy, from a stream
    of (cell_id, gene, value, time) rows that holds each cell's gene once a window."""
    v = F.col("value").cast("double")
    return rows.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), "cell_id").agg(
        F.sum(v).alias("total"), F.sum((v > 0).cast("long")).alias("n_detected"), F.sum(F.when(v > 0, v * F.log(v)).otherwise(0.0)).alias("xlogx"))
