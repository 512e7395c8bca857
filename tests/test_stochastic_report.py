import hashlib

import numpy as np
from fixtures import MARKERS, lineages, section

from labelq.operators import markers as mk
from labelq.operators import stochastic as st
from labelq.plans import report
from labelq.sources.section import Section, markers_from_dict
from pyspark.sql import functions as F


def test_thinning_is_repeatable_and_fair(spark):
    counts = spark.createDataFrame([(i, "g", 100.0) for i in range(50)], "cell_id long, gene string, value double")
    keep = spark.createDataFrame([(i, 0.8) for i in range(50)], "cell_id long, keep double")
    a = sorted(map(tuple, st.thin(counts, keep, 1).collect()))
    assert a == sorted(map(tuple, st.thin(counts.repartition(7), keep, 1).collect()))
    assert a != sorted(map(tuple, st.thin(counts, keep, 2).collect()))
    assert 76 < np.mean([r[2] for r in a]) < 84


def test_thinning_draws_each_unit_by_its_digest(spark):
    rows = [("a", "g", 7.0), ("a", "h", 2.9), ("b", "g", 0.4), ("b", "h", 0.0), ("c", "g", 12.0), ("d", "g", 5.0), ("e", "g", -3.0), ("f", "g", None)]
    p = {"a": 0.5, "b": 0.5, "c": 1.0, "d": 0.0, "e": 0.5, "f": 0.5}
    got = st.thin(spark.createDataFrame(rows, "cell_id string, gene string, value double"), spark.createDataFrame([*p.items()], "cell_id string, keep double"), 3)
    want = {}
    for cell, gene, value in rows:
        units = [int(hashlib.md5(f"3:{cell}:{gene}:{i}".encode()).hexdigest()[:8], 16) / 2 ** 32 for i in range(1, int(value or 0) + 1)]
        want[cell, gene] = float(sum(p[cell] >= 1 or u < p[cell] for u in units))
    assert {(r.cell_id, r.gene): r.value for r in got.collect()} == {k: v for k, v in want.items() if v}


def annotate(sets):
    def run(s: Section):
        loads = mk.set_loads(s.counts, mk.on_panel(sets, s.genes))
        best = loads.groupBy("cell_id").agg(F.max_by("set_name", "load").alias("label"))
        return s.cells.select("cell_id").join(best, "cell_id", "left")
    return run


def test_clear_labels_are_stable(spark):
    s = lineages(spark)[0]
    r = st.label_stability(s, annotate(markers_from_dict(spark, MARKERS)), reps=2).agg(F.avg(1 - F.col("label_stability"))).first()[0]
    assert r < 0.1


def panel(spark, n=40, seed=0):
    g = np.random.default_rng(seed)
    x = g.poisson(1, (4 * n, 30)).astype(float)
    labels = [t for t in "ABCD" for _ in range(n)]
    for k, t in enumerate(labels):
        x[k, {"A": 0, "B": 1, "C": 2, "D": 2}[t]] += g.poisson(20)
    return section(spark, x, labels)


def test_panel_tells_apart_what_it_can(spark):
    s = panel(spark)
    head, tiers = st.panel_resolvability(s, s.genes.select("gene"), target_depth=50.0)
    t = {r.label: r for r in tiers.collect()}
    assert t["A"].tier == t["B"].tier == "resolvable"
    assert t["C"].confused_with == "D" or t["D"].confused_with == "C"
    assert "not_resolvable" in {t["C"].tier, t["D"].tier}
    assert head.first().status == "ok" and head.first().n_types == 4
    few, none = st.panel_resolvability(s, s.genes.where("gene_idx < 10").select("gene"))
    assert few.first().status == "insufficient_overlap" and none is None


def test_index_bounds_and_missing_terms(spark):
    s = lineages(spark, n=120)[0]
    m = markers_from_dict(spark, MARKERS)
    r = report.quality_index(s, m, min_type_n=50).first()
    assert 0 <= r.aqi <= 1 and list(r.active_set) == ["C", "M"] and min(r.c, r.m) - 1e-9 <= r.aqi_core <= (r.c + r.m) / 2 + 1e-9 and r.regime == "index_only"
    dirty = report.quality_index(lineages(spark, 0.6, n=120)[0], m).first()
    assert dirty.aqi < r.aqi
    none = report.quality_index(s, None).first()
    assert none.aqi is None and none.argmin is None and list(none.active_set) == []
    capped = report.quality_index(s, m, reference=panel(spark), panel_genes=panel(spark).genes.select("gene")).first()
    assert capped.a is not None and capped.aqi <= min(capped.aqi_core, capped.a) + 1e-9


def test_battery_runs_and_guards(spark):
    s = lineages(spark, n=40)[0]
    out = report.annotation_quality(s, markers_from_dict(spark, MARKERS), sample_col="nothing_here", k=5)
    assert "status" in out["inter_sample_consistency"].columns and out["aqi"].count() == 1 and out["internal_validity"].first().status == "ok"


def test_section_rejects_bad_input(spark):
    import pytest

    with pytest.raises(ValueError):
        Section(spark.range(1))
    s = section(spark, [[1], [1]], ["a", "b"])
    s.check_keys()
    with pytest.raises(ValueError):
        Section(s.cells.union(s.cells), s.genes, s.counts).check_keys()
