import numpy as np
import pytest
from dataclasses import replace
from fixtures import section

from labelq.functions import permute
from labelq.functions.ranks import kth_smallest, quantiles
from labelq.operators import signal as sg
from labelq.operators import space as sp
from labelq.plans import report


def one(df):
    return df.first().asDict()


def test_sparsity_and_entropy_exact(spark):
    s = section(spark, [[10, 0, 0, 0, 0], [1, 1, 1, 1, 1]], ["a", "a"])
    c = {r.cell_id: r for r in sg.signal_cells(s).collect()}
    assert c[0].detection_entropy == 0 and c[1].detection_entropy == pytest.approx(1) and c[0].sparsity == pytest.approx(0.8)
    assert one(sg.sparsity(s))["zero_fraction"] == pytest.approx(0.4)
    assert one(sg.signal_to_noise(s))["median_mean_signal_ratio"] is None


def test_signal_over_controls_and_area(spark):
    s = section(spark, [[4, 8, 2], [0, 0, 1], [0, 0, 0]], ["a"] * 3, control={"g2"}, cell_area=[2.0, 0.0, None])
    c = {r.cell_id: r for r in sg.signal_cells(s).collect()}
    assert c[0].mean_signal_ratio == pytest.approx(np.log2(3)) and c[0].max_signal_ratio == pytest.approx(2)
    assert c[0].tx_per_area == 7 and c[1].tx_per_area is None and c[2].tx_per_area is None
    assert one(sg.signal_to_noise(s))["frac_cells_signal_below_control"] == pytest.approx(2 / 3)


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_are_exact(spark, seed):
    g = np.random.default_rng(seed)
    x = np.round(g.normal(0, 1, 301), 1)
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(x)] + [(0, None)], "g int, v double")
    got = {r.g: r for r in quantiles(df, ["g"], "v", {"m": 0.5, "p": 0.95}).collect()}
    for k in (0, 1):
        assert got[k].m == pytest.approx(np.median(x[k::2])) and got[k].p == pytest.approx(np.quantile(x[k::2], 0.95))
    from pyspark.sql import functions as F

    assert one(kth_smallest(df, [], "v", F.lit(17)))["kth"] == np.sort(x)[16]


def blocks(spark, w=8, h=4, seed=0):
    g = np.random.default_rng(seed)
    xy = [(i + g.normal(0, 0.01), j + g.normal(0, 0.01)) for i in range(w) for j in range(h)]
    labels = ["A" if i < w / 2 else "B" for i in range(w) for _ in range(h)]
    counts = [[8 if labels[k] == "A" else 0, g.poisson(1), g.poisson(1)] for k in range(w * h)]
    s = section(spark, counts, labels, coords=xy, control={"g2"})
    return replace(s, edges=sp.knn_edges(s.cells, 4)), np.array(xy), labels, np.array(counts, float)


def test_spatial_family(spark):
    s, xy, labels, x = blocks(spark)
    d = np.linalg.norm(xy[:, None] - xy[None], axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :4]
    assert {(r.src, r.dst) for r in s.edges.collect()} == {(i, int(j)) for i in range(len(xy)) for j in near[i]}
    same = np.mean([[labels[j] == labels[i] for j in near[i]] for i in range(len(xy))])
    r = one(sp.spatial_coherence(s.cells, s.edges))
    assert r["mean_coherence"] == pytest.approx(same) and r["pas"] < 0.15
    w = np.zeros((len(xy), len(xy)))
    for i in range(len(xy)):
        w[i, near[i]] = 0.25
    z = x - x.mean(0)
    want = [len(xy) / w.sum() * (z[:, k] @ w @ z[:, k]) / (z[:, k] @ z[:, k]) for k in range(3)]
    got = {r.gene: r.moran for r in sp.moran_genes(s, s.edges).collect()}
    assert [got[f"g{k}"] for k in range(3)] == pytest.approx(want)
    assert got["g0"] > 0.5
    assert not any(r.suspicious for r in sp.neighborhood_sanity(sp.nhood_enrichment(s.cells, s.edges)).collect())
    full = one(report.signal_report(s))
    assert full["n_controls"] == 1 and full["separation"] is not None


def test_isolated_cells_count_as_coherent_for_pas(spark):
    s = section(spark, np.zeros((3, 1)), ["a", "a", "b"])
    edges = spark.createDataFrame([(0, 2, 1.0)], "src long, dst long, weight double")
    assert one(sp.spatial_coherence(s.cells, edges)) == {"pas": pytest.approx(1 / 3), "mean_coherence": 0.0}


def test_exact_null_agrees_with_permutations(spark):
    s, *_ = blocks(spark)
    exact = {(r.a, r.b): r for r in sp.nhood_enrichment(s.cells, s.edges).collect()}
    drawn = {(r.a, r.b): r for r in sp.nhood_permuted(s.cells, s.edges, 400).collect()}
    for k, r in exact.items():
        assert drawn[k].mean == pytest.approx(r["mean"], rel=0.1) and drawn[k].sd == pytest.approx(r["sd"], rel=0.25)


@pytest.mark.parametrize("n", [1, 2, 700, 1025, 1681, 5000])
def test_a_relabelling_deals_each_place_once(n):
    every = permute.Relabelling([1] * n)
    dealt = [every.of_points(every.split(np.arange(n)), 3, rep) for rep in (0, 1)]
    assert all((np.sort(d) == np.arange(n)).all() for d in dealt) and (n < 3 or (dealt[0] != dealt[1]).any())
    some = np.arange(n)[::7][::-1]
    assert (every.of_points(every.split(some), 3, 0) == dealt[0][some]).all()
    sizes = [n // 3, 0, n - n // 3]
    few = permute.Relabelling(sizes)
    assert np.bincount(few.of_points(few.split(np.arange(n)), 3, 0), minlength=3).tolist() == sizes


def ring(spark, n, names="aaabbc"):
    """n cells in a ring, each linked to the next three; labels in turn."""
    cells = spark.range(n).selectExpr("id as cell_id", f"substring('{names}', cast(id % {len(names)} as int) + 1, 1) as label")
    return cells, cells.selectExpr("cell_id as src", "explode(array(1, 2, 3)) as k").selectExpr("src", f"(src + k) % {n} as dst", "1.0D as weight")


@pytest.mark.parametrize("n", [60, 1500])
def test_relabellings_have_the_exact_moments(spark, n):
    """Sixty cells are dealt by a drawn permutation, 1500 by the network."""
    cells, edges = ring(spark, n)
    exact = {(r.a, r.b): r for r in sp.nhood_enrichment(cells, edges).collect()}
    drawn = {(r.a, r.b): r for r in sp.nhood_permuted(cells, edges, 4000, 1).collect()}
    assert drawn.keys() == exact.keys() and len(exact) == 9
    for k, r in exact.items():
        assert abs(drawn[k]["mean"] - r["mean"]) < 4.5 * r.sd / 4000 ** 0.5 and drawn[k].sd == pytest.approx(r.sd, rel=0.06) and drawn[k].n == r.n


def test_relabellings_do_not_hang_on_how_rows_lie(spark, monkeypatch):
    cells, edges = ring(spark, 3000)
    want = sorted(map(tuple, sp.nhood_permuted(cells, edges, 20).collect()))
    monkeypatch.setattr(sp, "TASK_MOST", 300)
    monkeypatch.setattr(sp, "EDGES", 500)
    assert sorted(map(tuple, sp.nhood_permuted(cells.repartition(7), edges.repartition(5), 20).collect())) == want
    for most in (9 * 3, 8):  # three repetitions at once; more pairs of labels than are held
        monkeypatch.setattr(sp, "TALLIES", most)
        assert sorted(map(tuple, sp.nhood_permuted(cells, edges, 20).collect())) == want
    assert sorted(map(tuple, sp.nhood_permuted(cells, edges, 20, 1).collect())) != want


def test_relabelling_of_nothing(spark):
    cells, edges = ring(spark, 60)
    assert sp.nhood_permuted(cells.limit(0), edges, 20).count() == 0
    alone = sp.nhood_permuted(cells, edges.limit(0), 20).collect()
    assert len(alone) == 9 and all((r.n, r["mean"], r.sd, r.z) == (0, 0, 0, None) for r in alone)


def test_relabelling_sends_the_driver_no_rows_of_repetitions(spark):
    """A row for each of 1000 cells and 1000 repetitions was broadcast, by the size of the cells. The limit is above
    the 32 MB that a table of any size takes."""
    cells, edges = ring(spark, 1000)
    spark.conf.set("spark.sql.maxBroadcastTableSize", "40m")
    try:
        assert len(sp.nhood_permuted(cells, edges).collect()) == 9
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
