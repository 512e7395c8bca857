from dataclasses import replace

import numpy as np
import pytest
from fixtures import MARKERS, blobs, lineages, section

from labelq import api
from labelq.sources.section import counts_from_arrays, counts_from_columns


def test_every_metric_by_name(spark):
    s, x, labels, genes = lineages(spark)
    value, out = api.crisp_purity(s, MARKERS)
    assert value == 1.0 and "crisp_impure" in out.cells.columns
    assert api.mecr(s, MARKERS) == 0.0 and "pmp" in api.pmp(s, MARKERS).cells.columns
    r, out = api.per_cell_confidence(s, MARKERS)
    assert r["n_sets"] == 2 and r["mean_margin"] > 5 and {"marker_margin", "marker_entropy"} <= set(out.cells.columns)
    assert api.marker_program_fidelity(s, MARKERS)["mean_auc"] > 0.9 and api.marker_gene_overlap(s, MARKERS, 3)["mean_overlap"] == 1.0
    assert api.nmp(s)[0]["status"] == "skipped" and api.ncp(s)["status"] == "skipped"
    r, out = api.nmp(s, s)
    assert r["status"] == "ok" and 0 <= r["mean_nmp"] <= 1 and "nmp" in out.cells.columns
    assert 0 <= api.ncp(s, s, max_genes=8)["ncp"] <= 1


def test_signal_and_space_by_name(spark):
    g = np.random.default_rng(0)
    xy = g.uniform(0, 10, (40, 2))
    s = section(spark, g.poisson(1, (40, 5)), ["A" if p[0] < 5 else "B" for p in xy], control={"g4"}, coords=xy, cell_area=[1.5] * 40)
    q = api.run_signal_qc(s)
    assert set(q) == {"sparsity", "detection_entropy", "signal_to_noise", "tx_per_area", "moran"} and q["moran"]["n_genes"] == 4 and not any("status" in v for v in q.values())
    r, out = api.spatial_coherence(s, k=4)
    assert 0 <= r["pas"] <= 1 and r["k"] == 4 and "spatial_coherence" in out.cells.columns
    assert api.neighborhood_sanity(s)["categories"] == ["A", "B"] and len(api.neighborhood_sanity(s, n_perms=50)["self_enrichment"]) == 2
    bare = section(spark, g.poisson(1, (5, 3)), ["a"] * 5)
    assert api.signal_to_noise(bare)[0]["status"].startswith("skipped") and api.tx_per_area(bare)[0]["status"].startswith("skipped")


def test_labels_by_name(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "truth string, pred string")
    assert api.external_scores(df)["accuracy"] == 0.5 and set(api.external_scores(df)["per_class_f1"]) == {"a", "b", "c"}
    assert api.element_centric_similarity(df, "truth", "pred", 0.1) == api.element_centric_similarity(df, "pred", "truth", 0.9)
    assert api.hierarchical_accuracy(df, {"c": "up", "b": "up"})["lineage_accuracy"] == pytest.approx(0.75)
    assert api.composition_accuracy(df)["true"] == {"a": 0.5, "b": 0.25, "c": 0.25}


def test_validity_by_name(spark):
    x, y = blobs(k=3, per=10)
    s = section(spark, np.ones((30, 2)), y, vec=x, sample=[f"s{i % 2}" for i in range(30)], truth=y)
    assert api.internal_validity(s, k=5)["status"] == "ok" and api.avg_bio(s, "truth")["ari"] == pytest.approx(1)
    assert api.inter_sample_consistency(section(spark, np.ones((4, 2)), ["a"] * 4, sample=["s", "t"] * 2), "sample")["status"].startswith("skipped")
    out = api.annotation_quality(s, None, "sample", k=5)
    assert out["aqi"]["aqi"] is None and out["inter_sample_consistency"] == api.inter_sample_consistency(s, "sample")
    assert set(out["inter_sample_consistency"]["per_type"]) == {"T0", "T1", "T2"}


def test_a_part_that_fails_is_told(spark):
    s = section(spark, np.ones((4, 2)), ["a", "b"] * 2)
    out = api.annotation_quality(s, {"a": ["g0"]}, "no such column", k=1)
    assert out["inter_sample_consistency"]["status"].startswith("skipped: ") and "mean_auc" in out["marker_fidelity"]
    bad = s.cells.selectExpr("cell_id", "label", "raise_error('broken') as cell_area")
    q = api.run_signal_qc(type(s)(bad, s.genes, s.counts))
    assert set(q) == {"sparsity", "detection_entropy", "signal_to_noise", "tx_per_area"} and "broken" in q["tx_per_area"]["status"]


def test_index_is_told_in_parts(spark):
    x, y = blobs(k=3, per=60)
    g = np.random.default_rng(1)
    counts = g.poisson(0.2, (180, 6)) + 6 * (np.repeat(np.arange(6) // 2, 180).reshape(6, 180).T == np.array([int(t[1:]) for t in y])[:, None])
    s = section(spark, counts, y, vec=x, sample=[f"s{i % 2}" for i in range(180)])
    s = s.with_columns(s.cells.selectExpr("cell_id", "label as v1", "label as v2", "case when cell_id % 2 = 0 then label else 'other' end as v3"))
    sets = {f"T{k}": [f"g{2 * k}", f"g{2 * k + 1}"] for k in range(3)}
    out = api.annotation_quality(s, sets, "sample", k=5, voters=["v1", "v2", "v3"], reference=s, abstained=["T2"], provenance={"platform": "none"})["aqi"]
    assert set(out["components"]) == {"A", "C", "G", "M", "H", "completeness"} and out["components"]["A"] is None and out["components"]["H"] is not None
    assert out["abstention"] == {"signal": pytest.approx(2.5 / 3), "n_voters": 3, "available": True} and out["n_ge50_types"] == 2
    assert out["coverage"]["expected"] == ["T0", "T1", "T2"] and out["coverage"]["missing"] == ["T2"] == out["coverage"]["missing_vs_reference"] and out["coverage"]["n_ref_types_abundant"] == 3
    assert out["flags"]["missing_lineages"] and out["flags"]["missing_vs_reference"] and out["flags"]["adequacy_unknown"]
    assert set(out["cohort"]) == {"consistency", "per_type", "n_profiles"} and set(out["cohort"]["per_type"]) == {"T0", "T1", "T2"}
    assert out["provenance"] == {"platform": "none", "reference": True, "median_depth": None, "n_voters": 3}


def test_layers_and_other_embeddings(spark):
    x, y = blobs(k=2, per=10)
    s = section(spark, np.ones((20, 2)), y, vec=x, truth=y)
    swapped = spark.createDataFrame([(i, [float(i % 2), float(i % 3)]) for i in range(20)], "cell_id long, vec array<double>")
    assert api.avg_bio(s, "truth")["asw"] > 0.5 > api.avg_bio(s, "truth", embedding=swapped)["asw"]
    assert api.internal_validity(s, k=3, embedding=swapped)["silhouette"] < api.internal_validity(s, k=3)["silhouette"]
    twice = replace(s, layers={"twice": s.counts.selectExpr("cell_id", "gene", "if(gene = 'g0', 3.0, value) as value")})
    sets = {"a": ["g0"], "b": ["g1"]}
    assert api.per_cell_confidence(twice, sets)[0]["mean_margin"] == 0 and api.per_cell_confidence(twice, sets, layer="twice")[0]["mean_margin"] == 2
    with pytest.raises(ValueError, match="no layer"):
        api.per_cell_confidence(twice, sets, layer="none")


def test_repeated_keys_are_refused(spark):
    s = section(spark, np.ones((4, 2)), ["a", "b"] * 2)
    with pytest.raises(ValueError, match="not unique"):
        api.run_signal_qc(replace(s, cells=s.cells.union(s.cells)))


def test_wide_tables_and_arrays_become_counts(spark):
    wide = spark.createDataFrame([(1, 2, 0), (2, None, 5)], "id long, g0 int, g1 int")
    want = [(1, "g0", 2.0), (2, "g1", 5.0)]
    assert [tuple(r) for r in counts_from_columns(wide, "id", ["g0", "g1"]).orderBy("cell_id").collect()] == want
    dense = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 5.0]), (3, None)], "id long, x array<double>")
    genes = spark.createDataFrame([("g0", 0, False), ("g1", 1, False)], "gene string, gene_idx int, control boolean")
    assert [tuple(r) for r in counts_from_arrays(dense, "id", "x", genes).orderBy("cell_id").collect()] == want
