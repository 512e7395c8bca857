"""Exact nearest neighbours in the plane, without comparing all pairs.

Points are dealt to tiles of about equal size, strips between quantiles of x that are
cut between quantiles of y. A point's k nearest within its own tile bound its search
radius; it then visits the tiles that its circle reaches, and no others.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Points of a tile, on average.
TILE = 2048


def _cut(column: str, cuts):
    """Number of the interval that a value falls in: how many cuts are not above it."""
    return F.size(F.filter(cuts, lambda c: c <= F.col(column)))


def _closest(ids, x, y, tx, ty, tids, k, within=None) -> pd.DataFrame:
    """k nearest targets of each query (ties by id, itself left out), no farther than ``within``."""
    order = np.argsort(tids, kind="stable")
    tx, ty, tids = tx[order], ty[order], tids[order]
    out = []
    step = max(1, (1 << 21) // max(1, len(tids)))
    for a in range(0, len(ids), step):
        b = slice(a, a + step)
        d = np.round(np.sqrt((x[b, None] - tx) ** 2 + (y[b, None] - ty) ** 2), 12)
        d[ids[b, None] == tids] = np.inf
        if within is not None:
            d[d > within[b, None]] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        dist = np.take_along_axis(d, near, 1)
        ok = np.isfinite(dist)
        out.append(pd.DataFrame({"id": np.repeat(ids[b], ok.sum(1)), "nbr": tids[near[ok]], "distance": dist[ok]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"id": ids[:0], "nbr": ids[:0], "distance": []})


def nearest_in_plane(points: DataFrame, k: int, tile: int | None = None) -> DataFrame:
    """(id, nbr, distance, rank): the k nearest other points by x and y, ties by id; points:
    (id, x, y) without NULLs. Many points at one place share a tile whatever its size."""
    kind = points.schema["id"].dataType.simpleString()
    n = points.count()
    strips = max(1, math.ceil(math.sqrt(n / (tile or TILE))))
    levels = [i / strips for i in range(1, strips)]
    none = F.array().cast("array<double>")
    xcuts = points.agg(F.percentile_approx("x", levels, 10000).alias("xcuts")) if levels else points.sparkSession.range(1).select(none.alias("xcuts"))
    p = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).crossJoin(F.broadcast(xcuts))  # one row
    p = p.withColumn("strip", _cut("x", "xcuts"))
    ycuts = p.groupBy("strip").agg((F.percentile_approx("y", levels, 10000) if levels else F.first(none)).alias("ycuts"))
    p = p.join(ycuts, "strip").withColumn("line", _cut("y", "ycuts")).select("id", "x", "y", "strip", "line", "xcuts").persist()

    def own(t):
        ids, x, y = t.id.to_numpy(), t.x.to_numpy(), t.y.to_numpy()
        return _closest(ids, x, y, x, y, ids, k)

    pair = f"id {kind}, nbr {kind}, distance double"
    first = p.select("strip", "line", "id", "x", "y").groupBy("strip", "line").applyInPandas(own, pair).persist()
    reach = first.groupBy(F.col("id").alias("q_id")).agg(F.count("*").alias("found"), F.max("distance").alias("far"))
    radius = F.when(F.col("found") >= k, F.col("far")).otherwise(F.lit(float("inf")))
    q = p.join(reach, p.id == F.col("q_id"), "left").withColumn("radius", F.coalesce(radius, F.lit(float("inf"))))
    span = lambda c, cuts: F.sequence(F.size(F.filter(cuts, lambda v: v <= F.col(c) - F.col("radius") - 1e-9)), F.size(F.filter(cuts, lambda v: v <= F.col(c) + F.col("radius") + 1e-9)))
    q = q.withColumn("to", F.explode(span("x", "xcuts"))).join(ycuts.select(F.col("strip").alias("to"), "ycuts"), "to")
    q = q.withColumn("to_line", F.explode(span("y", "ycuts"))).where((F.col("to") != F.col("strip")) | (F.col("to_line") != F.col("line")))
    visits = q.select(F.col("to").alias("strip"), F.col("to_line").alias("line"), "id", "x", "y", "radius")

    def visit(v, t):
        if not len(v) or not len(t):
            return pd.DataFrame(columns=["id", "nbr", "distance"])
        return _closest(v.id.to_numpy(), v.x.to_numpy(), v.y.to_numpy(), t.x.to_numpy(), t.y.to_numpy(), t.id.to_numpy(), k, v.radius.to_numpy())

    tiles = p.select("strip", "line", "id", "x", "y").toDF("strip", "line", "id", "x", "y")
    more = visits.groupBy("strip", "line").cogroup(tiles.groupBy("strip", "line")).applyInPandas(visit, pair)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "nbr"))
    return first.union(more).withColumn("rank", rank).where(F.col("rank") <= k)
