"""Distances between rows of vectors, in blocks.

Both sides are dealt to blocks by a hash, every pair of blocks is one group, and a
group returns partial results that Spark aggregates: no side is broadcast or collected
and no task holds more than two blocks. The work is quadratic, as exact distances are;
callers bound it by a sample where the metric is defined on one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK = 2048


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "correlation":
        a, b, metric = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True), "cosine"
    if metric == "cosine":
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        return np.clip(1 - (a / np.where(na > 0, na, 1)[:, None]) @ (b / np.where(nb > 0, nb, 1)[:, None]).T, 0, 2)
    if metric != "euclidean":
        raise ValueError(f"unknown metric {metric}")
    step = max(1, (1 << 22) // max(1, b.size))
    return np.sqrt(np.concatenate([((a[k:k + step, None] - b[None]) ** 2).sum(2) for k in range(0, len(a), step)] or [np.zeros((0, len(b)))]))


def _blocks(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("block", F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(max(1, -(-n // BLOCK)))).cast("int"))


def block_pairs(left: DataFrame, right: DataFrame, fn, schema: str) -> DataFrame:
    """fn(left block, right block) -> frame, for all pairs of blocks; both sides have id and vec."""
    right = right.toDF(*right.columns)  # columns of its own, where both sides are one frame
    a, b = _blocks(left, n := left.count()), _blocks(right, m := right.count())
    a = a.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-m // BLOCK)) - 1))))
    b = b.withColumnRenamed("block", "other").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n // BLOCK)) - 1))))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return fn(x, y) if len(x) and len(y) else pd.DataFrame(columns=names)

    return a.groupBy("block", "other").cogroup(b.groupBy("block", "other")).applyInPandas(run, schema)


def nearest(points: DataFrame, others: DataFrame, k: int, metric: str = "euclidean", same: bool = True) -> DataFrame:
    """(id, nbr, rank, distance) of the k nearest others of each point, ties by id; with
    ``same`` both sides are the same rows and a point is not its own neighbour."""
    kind, okind = points.schema["id"].dataType.simpleString(), others.schema["id"].dataType.simpleString()

    def best(x, y):
        d = np.round(distances(_matrix(x.vec), _matrix(y.vec), metric), 12)
        ids = y.id.to_numpy()
        order = np.argsort(ids, kind="stable")
        d, ids = d[:, order], ids[order]
        if same:
            d[x.id.to_numpy()[:, None] == ids[None]] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        dist = np.take_along_axis(d, near, 1)
        ok = np.isfinite(dist)
        return pd.DataFrame({"id": np.repeat(x.id.to_numpy(), ok.sum(1)), "nbr": ids[near[ok]], "distance": dist[ok]})

    found = block_pairs(points.select("id", "vec"), others.select("id", "vec"), best, f"id {kind}, nbr {okind}, distance double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "nbr"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def distance_sums(points: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(id, label, other, total, n): sum of distances from each point to the points of each
    label, itself left out; points: (id, label, vec)."""
    kind = points.schema["id"].dataType.simpleString()

    def sums(x, y):
        d = distances(_matrix(x.vec), _matrix(y.vec), metric)
        d[x.id.to_numpy()[:, None] == y.id.to_numpy()[None]] = 0.0
        names, at = np.unique(y.label.to_numpy(str), return_inverse=True)
        one = np.zeros((len(y), len(names)))
        one[np.arange(len(y)), at] = 1
        total, n = d @ one, one.sum(0)
        return pd.DataFrame({"id": np.repeat(x.id.to_numpy(), len(names)), "label": np.repeat(x.label.to_numpy(), len(names)), "other": np.tile(names, len(x)),
                             "total": total.ravel(), "n": np.tile(n, len(x)).astype(int)})

    p = points.select("id", "label", "vec")
    found = block_pairs(p, p, sums, f"id {kind}, label string, other string, total double, n long")
    t = found.groupBy("id", "label", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return t.withColumn("n", F.col("n") - (F.col("label") == F.col("other")).cast("long"))


def centroids(points: DataFrame, by: str = "label") -> DataFrame:
    """(label, vec, n): mean vectors. Each task sums its rows, and sums are added by position."""
    def sums(batches):
        for b in batches:
            names, at = np.unique(b[by].to_numpy(str), return_inverse=True)
            m = _matrix(b.vec)
            yield pd.DataFrame({"label": names, "s": [m[at == k].sum(0) for k in range(len(names))], "n": np.bincount(at, minlength=len(names))})

    part = points.select(by, "vec").mapInPandas(sums, "label string, s array<double>, n long")
    n = part.groupBy("label").agg(F.sum("n").alias("n"))
    long = part.select("label", F.posexplode("s").alias("pos", "x")).groupBy("label", "pos").agg(F.sum("x").alias("x")).join(n, "label")
    return long.groupBy("label", "n").agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("x") / F.col("n")).alias("x")))).alias("v")).select("label", F.transform("v", lambda s: s["x"]).alias("vec"), "n")
