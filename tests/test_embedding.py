import numpy as np
import pytest
from fixtures import blobs, section

from labelq.operators import embedding as em
from labelq.operators import pairwise


def points(spark, x, labels):
    return spark.createDataFrame([(i, l, [float(v) for v in r]) for i, (r, l) in enumerate(zip(x, labels))], "id long, label string, vec array<double>")


def one(df):
    return df.first().asDict()


def by_hand(x, labels):
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    y = np.array(labels)
    out = []
    for i in range(len(x)):
        own = (y == y[i]) & (np.arange(len(x)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, y == t].mean() for t in set(y) - {y[i]})
        out.append((b - a) / max(a, b))
    return np.mean(out)


def test_clean_labels_beat_shuffled_ones(spark):
    x, y = blobs()
    good = one(em.internal_validity(points(spark, x, y), k=10))
    bad = one(em.internal_validity(points(spark, x, np.random.default_rng(1).permutation(y).tolist()), k=10))
    for k in ("silhouette", "silhouette_2label", "neighborhood_purity", "orbital_medoid", "ward_propmatch", "avg_similarity", "integrated", "calinski_harabasz"):
        assert good[k] > bad[k], k
    assert good["davies_bouldin"] < bad["davies_bouldin"]
    assert good["neighborhood_purity"] > 0.9 and 0 <= good["integrated"] <= 1 and good["ward_propmatch"] == 1.0 and good["n_used"] == len(x)


def test_silhouette_by_definition_across_blocks(spark, monkeypatch):
    x, y = blobs(k=3, per=9, d=3)
    y[0] = "alone"
    monkeypatch.setattr(pairwise, "BLOCK", 5)
    assert one(em.silhouettes(points(spark, x, y)))["silhouette"] == pytest.approx(by_hand(x, y))


def test_one_label_is_skipped(spark):
    x, _ = blobs(k=1, per=4)
    assert one(em.internal_validity(points(spark, x, ["a"] * 4)))["status"].startswith("skipped")


def test_ward_recovers_groups():
    x, y = blobs(k=3, per=12)
    got = em.ward_labels(x, 3)
    assert len({(a, b) for a, b in zip(y, got)}) == 3


def test_pca_scores_are_centred_and_ordered(spark):
    g = np.random.default_rng(0)
    x = g.poisson(3, (30, 5)) * np.array([5, 1, 1, 1, 1])
    s = section(spark, x, ["a"] * 30)
    got = np.array([r.vec for r in em.pca_fallback(s).orderBy("cell_id").collect()])
    z = x - x.mean(0)
    want = z @ np.linalg.svd(z, full_matrices=False)[2].T
    assert got.shape == (30, 5) and np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_consistency_across_samples(spark):
    g = np.random.default_rng(0)
    x, labels, sample = [], [], []
    for t in range(3):
        for k in range(4):
            for _ in range(5):
                row = g.poisson(1, 9).astype(float)
                row[t * 3:t * 3 + 3] += 9
                x.append(row)
                labels.append(f"t{t}")
                sample.append(f"s{k}")
    s = section(spark, x, labels, sample=sample)
    rows = {r.label: r for r in em.inter_sample_consistency(s).collect()}
    assert rows[None].consistency > 0.7 and rows[None].n_profiles == 12 and rows["t0"].n_profiles == 4
    assert em.inter_sample_consistency(section(spark, x, ["a"] * len(x), sample=sample)).count() == 0
    for metric in ("euclidean", "correlation"):
        assert em.inter_sample_consistency(s, metric=metric).count() == 4


def test_avg_bio_of_perfect_labels(spark):
    x, y = blobs(k=3, per=8)
    r = one(em.avg_bio(section(spark, np.ones((len(x), 1)), y, vec=x, truth=y)))
    assert r["ari"] == pytest.approx(1) and r["nmi"] == pytest.approx(1) and r["avg_bio"] > 0.9
