"""Cohesion and separation of labels in an embedding (internal validity), consistency
across samples, and agreement with the truth in the embedding.

points: (id, label, vec array<double>). Distances come from labelq.operators.pairwise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelq.functions.scalar import clip, share
from labelq.operators import agreement
from labelq.operators.pairwise import _matrix, centroids, distance_sums, nearest
from labelq.sources.section import Section, labels


def points_of(section: Section, label: str = "label") -> DataFrame:
    """(id, label, vec) of a section; without embeddings, the leading principal components."""
    emb = section.embeddings if section.embeddings is not None else pca_fallback(section)
    return section.cells.select("cell_id", labels(label).alias("label")).join(emb, "cell_id").select(F.col("cell_id").alias("id"), "label", F.col("vec").cast("array<double>").alias("vec"))


def pca_fallback(section: Section, most: int = 50) -> DataFrame:
    """(cell_id, vec): scores on the first min(most, genes, max(2, cells - 1)) components of the
    centred matrix."""
    n_genes, n_cells = section.genes.count(), section.cells.count()
    mean = section.counts.groupBy("gene").agg((F.sum(F.col("value").cast("double")) / n_cells).alias("mean"))
    order = section.genes.select("gene", (F.row_number().over(Window.partitionBy().orderBy("gene_idx")) - 1).alias("pos")).join(mean, "gene", "left").fillna(0.0, ["mean"])
    means = order.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("means"))
    own = section.counts.join(order, "gene").groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.col("value").cast("double")))).alias("own"))
    wide = section.cells.select("cell_id").join(own, "cell_id", "left").crossJoin(F.broadcast(means))  # one row
    wide = wide.select("cell_id", F.transform("means", lambda m, i: F.coalesce(F.element_at("own", i), F.lit(0.0)) - m).alias("x"))
    data = wide.select("cell_id", array_to_vector("x").alias("x"))
    k = min(most, n_genes, max(2, n_cells - 1))
    return PCA(k=k, inputCol="x", outputCol="pc").fit(data).transform(data).select("cell_id", vector_to_array("pc").alias("vec"))


def sample(points: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """All points, or the ``most`` of least hash: the metrics below are defined on such a sample."""
    return points if points.count() <= most else points.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most)


def neighborhood_purity(points: DataFrame, k: int = 30) -> DataFrame:
    """One row: mean share of a point's k nearest others with its label, ties by id."""
    own = points.select("id", "label")
    near = nearest(points, points, k).join(own, "id").join(own.select(F.col("id").alias("nbr"), F.col("label").alias("nbr_label")), "nbr")
    same = near.groupBy("id").agg(F.avg((F.col("label") == F.col("nbr_label")).cast("double")).alias("same"))
    return same.agg(F.avg("same").alias("neighborhood_purity"))


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _square(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def medoids(points: DataFrame) -> DataFrame:
    """(label, id, vec): of each label the point nearest its centroid, ties by id."""
    c = centroids(points).select("label", F.col("vec").alias("c"))
    d = points.join(c, "label").select("label", "id", "vec", F.round(_square("vec", "c"), 12).alias("d"))
    return d.groupBy("label").agg(F.min(F.struct("d", "id", "vec")).alias("m")).select("label", "m.id", "m.vec")


def orbital_medoid(points: DataFrame) -> DataFrame:
    """One row: share of points whose nearest medoid is their own label's; ties go to the label that sorts first."""
    m = medoids(points).select(F.col("label").alias("id"), "vec")
    near = nearest(points, m, 1, same=False).join(points.select("id", "label"), "id")
    return near.agg(F.avg((F.col("nbr") == F.col("label")).cast("double")).alias("orbital_medoid"))


def avg_similarity(points: DataFrame) -> DataFrame:
    """One row: mean cosine of a point and its label's centroid; 0 for a zero vector."""
    j = points.join(centroids(points).select("label", F.col("vec").alias("c")), "label")
    return j.agg(F.avg(share(_dot("vec", "c"), F.sqrt(_dot("vec", "vec")) * F.sqrt(_dot("c", "c")), F.lit(0.0))).alias("avg_similarity"))


def silhouette_points(points: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(id, label, s, s2): silhouette, 0 for the only point of a label, and the silhouette against
    all others pooled, NULL for such a point or without others."""
    d = distance_sums(points, metric)
    own = F.col("label") == F.col("other")
    mean = share(F.col("total"), F.col("n"))
    t = d.groupBy("id", "label").agg(F.max(F.when(own, mean)).alias("a"), F.min(F.when(~own, mean)).alias("b"), share(F.sum(F.when(~own, F.col("total"))), F.sum(F.when(~own, F.col("n")))).alias("rest"))
    score = lambda b: F.coalesce(F.try_divide(b - F.col("a"), F.greatest(F.col("a"), b)), F.lit(0.0))
    return t.select("id", "label", F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(score(F.col("b"))).alias("s"), F.when(F.col("a").isNotNull() & F.col("rest").isNotNull(), score(F.col("rest"))).alias("s2"))


def silhouettes(points: DataFrame, metric: str = "euclidean") -> DataFrame:
    """One row: silhouette and silhouette_2label; 0 with one label."""
    return silhouette_points(points, metric).agg(F.avg("s").alias("silhouette"), F.coalesce(F.avg("s2"), F.lit(0.0)).alias("silhouette_2label"))


def scatter_indices(points: DataFrame) -> DataFrame:
    """One row: davies_bouldin (lower is better) and calinski_harabasz."""
    c = centroids(points).select("label", F.col("vec").alias("c"), F.col("n").alias("members"))
    j = points.join(c, "label").withColumn("d2", _square("vec", "c"))
    spread = j.groupBy("label").agg(F.avg(F.sqrt("d2")).alias("spread")).join(c, "label")
    other = spread.select(F.col("label").alias("other"), F.col("spread").alias("other_spread"), F.col("c").alias("other_c"))
    worst = spread.crossJoin(other).where("label <> other").groupBy("label").agg(F.max(share(F.col("spread") + F.col("other_spread"), F.sqrt(_square("c", "other_c")), F.lit(0.0))).alias("worst"))
    whole = centroids(points.withColumn("all", F.lit("all")), "all").select(F.col("vec").alias("mean"), F.col("n").alias("rows"))
    between = c.crossJoin(whole).agg(F.sum(F.col("members") * _square("c", "mean")).alias("between"), F.count("*").alias("k"), F.max("rows").alias("rows"))
    ch = between.crossJoin(j.agg(F.sum("d2").alias("within"))).select(F.when(F.col("within") == 0, 1.0).otherwise(
        F.try_divide(F.col("between") * (F.col("rows") - F.col("k")), F.col("within") * (F.col("k") - 1))).alias("calinski_harabasz"))
    return worst.agg(F.avg("worst").alias("davies_bouldin")).crossJoin(ch)


def ward_labels(x: np.ndarray, k: int) -> np.ndarray:
    """Ward clusters of the rows of x, by chains of nearest neighbours and the Lance-Williams update."""
    n = len(x)
    if n <= k:
        return np.arange(n)
    d = ((x[:, None] - x[None]) ** 2).sum(2) if n * n * x.shape[1] < 1 << 24 else np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0)
    np.fill_diagonal(d, np.inf)
    size, alive, merges, chain = np.ones(n), np.ones(n, bool), [], []
    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            i = chain[-1]
            j = int(np.argmin(d[i]))
            if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
                j = chain[-2]
            if len(chain) > 1 and j == chain[-2]:
                break
            chain.append(j)
        i, j = chain.pop(), chain.pop()
        merges.append((d[i, j], i, j))
        new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / (size[i] + size[j] + size)
        d[j], d[:, j] = new, new
        d[i], d[:, i] = np.inf, np.inf
        d[j, j] = np.inf
        d[j, ~alive] = d[~alive, j] = np.inf
        size[j] += size[i]
        alive[i] = False
    parent = np.arange(n)

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for _, i, j in sorted(merges, key=lambda m: m[0])[:n - k]:
        parent[root(i)] = root(j)
    return np.unique([root(v) for v in range(n)], return_inverse=True)[1]


def ward_propmatch(points: DataFrame, most: int = 2000, seed: int = 0) -> DataFrame:
    """One row: mean over labels of the largest share that one of K Ward clusters has of the
    label. Clustering is quadratic and has one task; it is run on at most ``most`` points."""
    k = points.select("label").distinct().count()

    def cluster(batches):
        p = pd.concat(list(batches), ignore_index=True).sort_values("id", ignore_index=True)
        yield pd.DataFrame({"label": p.label, "cluster": ward_labels(_matrix(p.vec), k)})

    found = sample(points, most, seed).select("id", "label", "vec").repartition(1).mapInPandas(cluster, "label string, cluster long")
    n = found.groupBy("label", "cluster").agg(F.count("*").alias("n"))
    return n.groupBy("label").agg((F.max("n") / F.sum("n")).alias("m")).agg(F.avg("m").alias("ward_propmatch"))


def internal_validity(points: DataFrame, k: int = 30, subsample: int = 2000, seed: int = 0) -> DataFrame:
    """One row with the eight indices, ``integrated`` (geometric mean of six of them) and
    n_used; status 'skipped' and NULLs below two labels."""
    spark = points.sparkSession
    if points.select("label").distinct().limit(2).count() < 2:
        return spark.range(1).select(F.lit("skipped: fewer than 2 labels").alias("status"))
    n = points.count()
    some = sample(points, subsample, seed)
    out = silhouettes(some)
    for part in (neighborhood_purity(points, min(k, n - 1)), orbital_medoid(points), ward_propmatch(points, subsample, seed), avg_similarity(points), scatter_indices(some)):
        out = out.crossJoin(part)
    unit = [(F.col(c) + 1) / 2 for c in ("silhouette", "silhouette_2label", "avg_similarity")] + [F.col(c) for c in ("neighborhood_purity", "orbital_medoid", "ward_propmatch")]
    integrated = F.exp(sum((F.log(clip(u, 1e-9, 1.0)) for u in unit), F.lit(0.0)) / len(unit))
    return out.select("*", integrated.alias("integrated"), F.lit(min(n, subsample)).cast("long").alias("n_used"), F.lit("ok").alias("status"))


def profiles(section: Section, sample_col: str = "sample") -> DataFrame:
    """(id, label, vec): mean count vector of each label in each sample, over all genes."""
    cells = section.cells.select("cell_id", labels().alias("label"), labels(sample_col).alias("sample"))
    n = cells.groupBy("label", "sample").agg(F.count("*").alias("n"))
    s = section.counts.join(cells, "cell_id").groupBy("label", "sample", "gene").agg(F.sum(F.col("value").cast("double")).alias("s"))
    grid = n.crossJoin(section.genes.select("gene", "gene_idx")).join(s, ["label", "sample", "gene"], "left")
    vec = F.transform(F.array_sort(F.collect_list(F.struct("gene_idx", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("x")))), lambda v: v["x"])
    return grid.groupBy("label", "sample").agg(vec.alias("vec")).select(F.concat_ws("\x1f", "label", "sample").alias("id"), "label", "vec")


def inter_sample_consistency(section: Section, sample_col: str = "sample", metric: str = "cosine") -> DataFrame:
    """(label, consistency, n_profiles): mean silhouette of the label's profiles across samples, and
    in the row with a NULL label over all profiles. No rows where no label has two profiles or there is one label."""
    s = silhouette_points(profiles(section, sample_col), metric)
    t = s.groupBy("label").agg(F.avg("s").alias("consistency"), F.count("*").alias("n_profiles"))
    whole = s.agg(F.lit(None).cast("string").alias("label"), F.avg("s").alias("consistency"), F.count("*").alias("n_profiles"), F.count_distinct("label").alias("kinds")).where("kinds > 1 and n_profiles > kinds").drop("kinds")
    ok = whole.select(F.lit(True).alias("ok"))
    return t.crossJoin(ok).drop("ok").union(whole)


def avg_bio(section: Section, truth: str = "truth") -> DataFrame:
    """One row: ari, nmi, asw (silhouette of the truth's labels, all points) and their mean avg_bio."""
    c = agreement.contingency(section.cells, truth, "label")
    out = agreement.rand_index(c).crossJoin(agreement.normalized_information(c)).crossJoin(silhouettes(points_of(section, truth)).select(F.col("silhouette").alias("asw")))
    return out.select("ari", "nmi", "asw", ((F.col("ari") + F.col("nmi") + (F.col("asw") + 1) / 2) / 3).alias("avg_bio"))
