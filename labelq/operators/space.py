"""Spatial evidence on a neighbour graph: edges (src, dst, weight), passed in explicitly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelq.functions.permute import Relabelling
from labelq.functions.scalar import share
from labelq.operators.plane import nearest_in_plane
from labelq.sources.section import Section, labels

#: Cells of a bucket in which relabelling numbers them; cells a task counts the edges of, at least if
#: there are cores for more tasks and at most, on average.
SLOTS, TASK_LEAST, TASK_MOST = 1 << 11, 1 << 11, 1 << 16
#: Edges that a task relabels at once, and counts that it holds then.
EDGES, TALLIES = 1 << 19, 1 << 20


def knn_edges(cells: DataFrame, k: int, x: str = "x", y: str = "y") -> DataFrame:
    """(src, dst, weight): directed edges of weight 1 to the k nearest other cells, ties by id."""
    p = cells.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col("cell_id").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return nearest_in_plane(p, k).select(F.col("id").alias("src"), F.col("nbr").alias("dst"), F.lit(1.0).alias("weight"))


def _ends(cells: DataFrame, edges: DataFrame) -> DataFrame:
    own = cells.select(F.col("cell_id").alias("src"), labels().alias("a"))
    return edges.join(own, "src").join(own.select(F.col("src").alias("dst"), F.col("a").alias("b")), "dst")


def coherence_cells(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """(cell_id, spatial_coherence): weight share of same-label neighbours, NULL without any."""
    s = _ends(cells, edges).groupBy("src").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("same"), F.sum("weight").alias("degree"))
    return cells.select("cell_id").join(s, F.col("cell_id") == F.col("src"), "left").select("cell_id", F.when(F.col("degree") > 0, F.col("same") / F.col("degree")).alias("spatial_coherence"))


def spatial_coherence(cells: DataFrame, edges: DataFrame, pas_threshold: float = 0.2) -> DataFrame:
    """One row: pas, the share of cells below the threshold (isolated cells count as 1), and the
    mean over cells that have neighbours."""
    c = coherence_cells(cells, edges)
    return c.agg(F.avg((F.coalesce("spatial_coherence", F.lit(1.0)) < pas_threshold).cast("double")).alias("pas"), F.avg("spatial_coherence").alias("mean_coherence"))


def nhood_counts(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, n): edges from a cell of label a to one of label b, for all pairs of labels."""
    used = cells.select(labels().alias("a")).distinct()
    n = _ends(cells, edges).groupBy("a", "b").agg(F.count("*").alias("n"))
    return used.crossJoin(used.select(F.col("a").alias("b"))).join(n, ["a", "b"], "left").fillna(0, ["n"])


def nhood_enrichment(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, n, mean, sd, z): neighbour counts against their exact mean and deviation under random
    relabelling of the cells. edges: directed, no loops, no repeats. NULL z where sd is 0."""
    e = edges.select("src", "dst")
    out = e.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("o"))
    into = e.groupBy(F.col("dst").alias("w")).agg(F.count("*").alias("i"))
    both = out.join(into, out.v == into.w, "full_outer").fillna(0, ["o", "i"])
    o, i = F.col("o").cast("double"), F.col("i").cast("double")
    deg = both.agg(F.sum(o).alias("edges"), F.sum(o * (o - 1)).alias("ss"), F.sum(i * (i - 1)).alias("ii"), F.sum(i * o).alias("io"))
    back = e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).agg(F.count("*").cast("double").alias("back"))
    size = cells.groupBy(labels().alias("label")).agg(F.count("*").cast("double").alias("k"))
    n = cells.agg(F.count("*").cast("double").alias("cells"))
    t = nhood_counts(cells, edges).join(size.select(F.col("label").alias("a"), F.col("k").alias("x")), "a").join(size.select(F.col("label").alias("b"), F.col("k").alias("y")), "b")
    t = t.crossJoin(deg).crossJoin(back).crossJoin(n)
    x, y, N, E, R = (F.col(c) for c in ("x", "y", "cells", "edges", "back"))
    ss, sd_, ht = F.col("ss"), F.col("ii"), 2 * (F.col("io") - R)
    dj = E * E - E - R - ss - sd_ - ht
    n2, n3, n4 = N * (N - 1), N * (N - 1) * (N - 2), N * (N - 1) * (N - 2) * (N - 3)
    same = F.col("a") == F.col("b")
    over = lambda p, q: F.coalesce(F.try_divide(p, q), F.lit(0.0))
    x2, x3, x4 = x * (x - 1), x * (x - 1) * (x - 2), x * (x - 1) * (x - 2) * (x - 3)
    mean = F.when(same, over(E * x2, n2)).otherwise(over(E * x * y, n2))
    square = F.when(same, over((E + R) * x2, n2) + over((ss + sd_ + ht) * x3, n3) + over(dj * x4, n4)).otherwise(
        over(E * x * y, n2) + over(ss * x * y * (y - 1) + sd_ * x * (x - 1) * y + ht * 0.0, n3) + over(dj * x * (x - 1) * y * (y - 1), n4))
    t = t.withColumn("mean", mean).withColumn("sd", F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))))
    return t.select("a", "b", "n", "mean", "sd", F.try_divide(F.col("n") - F.col("mean"), F.col("sd")).alias("z"))


def _numbered(cells: DataFrame, n: int) -> DataFrame:
    """(cell_id, slot): the cells numbered from 0 to n - 1, in the order of a hash's bucket and the id."""
    p = cells.select("cell_id", F.pmod(F.xxhash64("cell_id"), F.lit(n // SLOTS + 1)).alias("bucket"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over a row a bucket
    base = p.groupBy("bucket").agg(F.count("*").alias("rows")).select("bucket", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("cell_id")) - 1
    return p.withColumn("place", place).join(base, "bucket").select("cell_id", (F.col("base") + F.col("place")).alias("slot"))


def _edge_counts(src: np.ndarray, dst: np.ndarray, deal: Relabelling, names: list[str], reps: int, seed: int):
    """Frames (a, b, first, counts): edges between two labels in the repetitions from ``first`` on."""
    k = len(names)
    points, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    points, src, dst = deal.split(points), ends[: len(src)], ends[len(src) :]
    at_once = max(1, min(reps, TALLIES // (k * k)))
    for first in range(0, reps, at_once):
        tallies = []
        for rep in range(first, min(reps, first + at_once)):
            label = deal.of_points(points, seed, rep)
            pair = label.take(src).astype(np.int64)
            pair *= k
            pair += label.take(dst)
            tallies.append(np.bincount(pair, minlength=k * k) if k * k <= TALLIES else np.unique(pair, return_counts=True))
        if k * k <= TALLIES:
            counts = np.stack(tallies, axis=1)
            pairs = np.flatnonzero(counts.any(axis=1))
            counts = counts[pairs]
        else:
            pairs, counts = tallies[0][0], tallies[0][1][:, None]
        yield pd.DataFrame({"a": [names[p // k] for p in pairs], "b": [names[p % k] for p in pairs], "first": np.full(len(pairs), first, np.int32), "counts": [c.astype("<i8").tobytes() for c in counts]})


def nhood_permuted(cells: DataFrame, edges: DataFrame, reps: int = 1000, seed: int = 0) -> DataFrame:
    """As nhood_enrichment(), from ``reps`` random relabellings, of which each deals all labels anew
    to all cells. Loops and repeated edges count as often as they are there.

    A relabelling is a function of the cell's number (functions/permute.py): a task works it out for
    the ends of its own edges, so that no row is made for a cell or an edge and a repetition. What
    tasks send on is, for each pair of labels, an array of counts. The labels' sizes go to the driver."""
    sizes = sorted((r.label, r["count"]) for r in cells.groupBy(labels().alias("label")).count().collect())
    names, n = [label for label, _ in sizes], sum(size for _, size in sizes)
    deal = Relabelling([size for _, size in sizes])
    slots = _numbered(cells, n)
    ends = edges.select("src", "dst").join(slots.select(F.col("cell_id").alias("src"), F.col("slot").alias("s")), "src").join(slots.select(F.col("cell_id").alias("dst"), F.col("slot").alias("d")), "dst").select("s", "d")
    tasks = max(n // TASK_MOST, min(n // TASK_LEAST, 2 * cells.sparkSession.sparkContext.defaultParallelism)) + 1

    def count(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch.to_numpy())
            rows += len(batch)
            if rows >= EDGES:
                yield from _edge_counts(*np.concatenate(held).T, deal, names, reps, seed)
                held, rows = [], 0
        if rows:
            yield from _edge_counts(*np.concatenate(held).T, deal, names, reps, seed)

    def moments(key, parts):
        k = np.zeros(reps, np.int64)
        for first, counts in zip(parts["first"], parts["counts"]):
            found = np.frombuffer(counts, "<i8")
            k[first : first + len(found)] += found
        return pd.DataFrame({"a": [key[0]], "b": [key[1]], "mean": [k.mean()], "sd": [k.std()]})

    counts = ends.repartition(tasks, "s").mapInPandas(count, "a string, b string, first int, counts binary")
    m = counts.groupBy("a", "b").applyInPandas(moments, "a string, b string, mean double, sd double")
    t = nhood_counts(cells, edges).join(m, ["a", "b"], "left").fillna(0.0, ["mean", "sd"])
    return t.select("a", "b", "n", "mean", "sd", F.try_divide(F.col("n") - F.col("mean"), F.col("sd")).alias("z"))


def neighborhood_sanity(enriched: DataFrame) -> DataFrame:
    """(label, self_z, stronger_with, cross_z, suspicious): a label is suspicious when another one
    is its strongest partner; ties go to the label that sorts first."""
    first = F.struct((-F.coalesce("z", F.lit(float("-inf")))).alias("minus"), F.col("b"))
    t = enriched.groupBy(F.col("a").alias("label")).agg(F.max(F.when(F.col("a") == F.col("b"), F.col("z"))).alias("self_z"), F.min(first).alias("best"), F.count("*").alias("k"))
    odd = (F.col("k") > 1) & (F.col("best.b") != F.col("label"))
    return t.select("label", "self_z", F.when(odd, F.col("best.b")).alias("stronger_with"), F.when(odd, -F.col("best.minus")).alias("cross_z"), odd.alias("suspicious"))


def moran_genes(section: Section, edges: DataFrame) -> DataFrame:
    """(gene, control, moran): Moran's I of each gene with rows of weights normalised to 1; NULL
    for a constant gene. Zero counts enter through the mean; the plan joins non-zero counts only:
    sum_ij w (x_i - m)(x_j - m) = sum w x_i x_j - m sum x_i r_i - m sum x_j c_j + m m W."""
    w = edges.join(edges.groupBy("src").agg(F.sum("weight").alias("degree")), "src").select("src", "dst", share(F.col("weight"), F.col("degree")).alias("w")).where("w is not null")
    rows = w.groupBy(F.col("src").alias("cell_id")).agg(F.sum("w").alias("r"))
    cols = w.groupBy(F.col("dst").alias("cell_id")).agg(F.sum("w").alias("c"))
    x = section.counts.select("cell_id", "gene", F.col("value").cast("double").alias("v"))
    cross = w.join(x.select(F.col("cell_id").alias("src"), "gene", F.col("v").alias("u")), "src").join(x.select(F.col("cell_id").alias("dst"), "gene", "v"), ["dst", "gene"]).groupBy("gene").agg(F.sum(F.col("w") * F.col("u") * F.col("v")).alias("wxx"))
    n = section.cells.agg(F.count("*").cast("double").alias("n")).crossJoin(w.agg(F.sum("w").alias("W")))
    side = x.join(rows, "cell_id", "left").join(cols, "cell_id", "left").groupBy("gene").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"), F.sum(F.col("v") * F.coalesce("r", F.lit(0.0))).alias("xr"), F.sum(F.col("v") * F.coalesce("c", F.lit(0.0))).alias("xc"))
    t = section.genes.select("gene", F.coalesce("control", F.lit(False)).alias("control")).join(side, "gene", "left").join(cross, "gene", "left").fillna(0.0, ["s", "ss", "xr", "xc", "wxx"]).crossJoin(n)
    m = F.col("s") / F.col("n")
    top = F.col("wxx") - m * F.col("xr") - m * F.col("xc") + m * m * F.col("W")
    bottom = F.col("ss") - F.col("n") * m * m
    return t.select("gene", "control", F.when(bottom > 1e-12, F.col("n") / F.col("W") * top / bottom).alias("moran"))


def moran_signal(genes: DataFrame) -> DataFrame:
    """One row: medians of genes and controls, separation, and the share of genes above the
    controls' 95th percentile; NULLs without controls.

    One aggregation: the table has a row a gene, so its exact percentiles and its values fit in
    one buffer, and the plan below it, which grows with the cells, is run once."""
    of = lambda c: F.when(F.col("control"), F.col("moran")) if c else F.when(~F.col("control"), F.col("moran"))
    t = genes.agg(F.percentile(of(False), F.lit(0.5)).alias("median_gene_moran"), F.percentile(of(True), F.lit(0.5)).alias("median_control_moran"), F.percentile(of(True), F.lit(0.95)).alias("p95"),
                  F.sum((~F.col("control")).cast("long")).alias("n_genes"), F.sum(F.col("control").cast("long")).alias("n_controls"), F.collect_list(of(False)).alias("own"))
    above = F.size(F.filter("own", lambda v: v > F.col("p95"))).cast("double")
    return t.select("median_gene_moran", "median_control_moran", "n_genes", "n_controls", (F.col("median_gene_moran") - F.col("median_control_moran")).alias("separation"),
                    F.when(F.col("p95").isNotNull(), F.try_divide(above, F.size("own"))).alias("frac_genes_above_control_p95"))
