import numpy as np
import pytest
from fixtures import MARKERS, lineages, section

from labelq.operators import markers as mk
from labelq.sources.section import markers_from_dict


def one(df):
    return df.first().asDict()


def test_fidelity_and_overlap_follow_the_labels(spark):
    clean, x, labels, genes = lineages(spark)
    m = markers_from_dict(spark, MARKERS)
    f = {r.set_name: r for r in mk.marker_fidelity(clean, m).collect()}
    assert f["T"].auc > 0.9 and f["T"].cohens_d > 0.5 and f["T"].n == 30
    mixed = section(spark, x, np.random.default_rng(1).permutation(labels).tolist(), genes)
    assert {r.set_name: r for r in mk.marker_fidelity(mixed, m).collect()}["T"].auc < 0.8
    assert all(r.overlap == 1.0 for r in mk.marker_overlap(clean, m, 3).collect())


def test_auc_by_pairs(spark):
    g = np.random.default_rng(5)
    x = g.poisson(1.0, (50, 4)).astype(float)
    labels = g.choice(["a", "b"], 50).tolist()
    s = section(spark, x, labels)
    m = markers_from_dict(spark, {"a": ["g0", "g1", "g1"], "c": ["g2"], "off": ["zz"]})
    got = {r.set_name: r for r in mk.marker_fidelity(s, m).collect()}
    load = x[:, 0] + 2 * x[:, 1]
    pos, neg = load[[y == "a" for y in labels]], load[[y != "a" for y in labels]]
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    sd = np.sqrt(((len(pos) - 1) * pos.var(ddof=1) + (len(neg) - 1) * neg.var(ddof=1)) / (len(pos) + len(neg) - 2))
    assert got["a"].auc == pytest.approx(auc) and got["a"].cohens_d == pytest.approx((pos.mean() - neg.mean()) / sd)
    assert got["c"].n == 0 and got["c"].auc is None and "off" not in got


def test_purity_family(spark):
    m = markers_from_dict(spark, MARKERS)
    clean, dirty = lineages(spark)[0], lineages(spark, 0.5)[0]
    assert one(mk.crisp_purity(clean, m))["crisp_purity"] == 1.0 and one(mk.mecr(clean, m))["mecr"] == 0.0
    assert one(mk.crisp_purity(dirty, m))["crisp_purity"] == pytest.approx(0.5)
    assert one(mk.mecr(dirty, m))["mecr"] == pytest.approx(0.5)
    p = [r.pmp for r in mk.pmp_cells(dirty, m).collect()]
    assert min(p) == pytest.approx(0.5) and max(p) == 1.0


def test_pmp_is_null_without_evidence(spark):
    s = section(spark, [[0, 0, 3], [2, 0, 0], [1, 1, 0]], ["a", "a", "x"])
    got = {r.cell_id: r.pmp for r in mk.pmp_cells(s, markers_from_dict(spark, {"a": ["g0"], "b": ["g1"]})).collect()}
    assert got == {0: None, 1: 1.0, 2: None}


def test_no_detection_at_all(spark):
    s = section(spark, [[0, 0], [0, 0]], ["a", "b"])
    m = markers_from_dict(spark, {"a": ["g0"], "b": ["g1"]})
    assert one(mk.crisp_purity(s, m))["crisp_purity"] == 1.0 and one(mk.mecr(s, m))["mecr"] == 0.0


def test_confidence(spark):
    s = section(spark, [[4, 0], [2, 2], [0, 0]], ["a", "a", "b"])
    got = {r.cell_id: (r.marker_margin, r.marker_entropy) for r in mk.marker_confidence(s, markers_from_dict(spark, {"a": ["g0"], "b": ["g1"]})).collect()}
    assert got[0][0] == 4 and got[1] == (0, pytest.approx(1)) and got[2] == (0, pytest.approx(1)) and got[0][1] < 0.2
    few = {r.cell_id: (r.marker_margin, r.marker_entropy) for r in mk.marker_confidence(s, markers_from_dict(spark, {"a": ["g0"], "b": ["zz"]})).collect()}
    assert few == {0: (0, 1), 1: (0, 1), 2: (0, 1)}


def _rates(x, pairs):
    pos = x > 0
    return {(i, j): ((pos[:, i] & pos[:, j]).sum(), (pos[:, i] | pos[:, j]).sum()) for i, j in pairs}


def test_negative_markers_and_pairs(spark):
    g = np.random.default_rng(2)
    a, b = g.poisson(0.5, (40, 12)).astype(float), g.poisson(0.5, (30, 12)).astype(float)
    la, lb = g.choice(["t", "u", "w"], 40).tolist(), g.choice(["t", "u"], 30).tolist()
    s, r = section(spark, a, la), section(spark, b, lb)
    want = []
    for i in range(40):
        if la[i] not in lb or a[i].sum() == 0:
            want.append(0.0)
            continue
        mean = b[[y == la[i] for y in lb]].mean(0)
        low = sorted(range(12), key=lambda k: (mean[k], k))[:2]
        want.append(a[i, low].sum() / a[i].sum())
    got = {x.cell_id: x.nmp for x in mk.nmp_cells(s, r).collect()}
    assert [got[i] for i in range(40)] == pytest.approx(want)
    top = sorted(sorted(range(12), key=lambda k: (-b[:, k].sum(), k))[:8])
    pairs = [(i, j) for x, i in enumerate(top) for j in top[x + 1:]]
    ref = _rates(b, pairs)
    apart = [p for p in pairs if ref[p][1] > 0 and ref[p][0] <= 0.15 * ref[p][1]][:10]
    now = _rates(a, apart)
    keep = np.mean([now[p][1] == 0 or now[p][0] <= 0.15 * now[p][1] for p in apart])
    res = one(mk.ncp(s, r, 0.15, 8, 10))
    assert res["n_pairs"] == len(apart) and res["ncp"] == pytest.approx(keep)


def test_dropped_lineage_is_missing(spark):
    x = np.zeros((120, 6))
    for i in range(120):
        x[i, (i % 3) * 2:(i % 3) * 2 + 2] = 5 + i % 4
    s = section(spark, x, ["A" if i % 3 == 0 else "B" for i in range(120)])
    m = markers_from_dict(spark, {"A": ["g0", "g1"], "B": ["g2", "g3"], "C": ["g4", "g5"]})
    got = {r.set_name: r for r in mk.lineage_coverage(s, m).collect()}
    assert got["C"].missing and not got["A"].missing and got["C"].missing_frac == pytest.approx(1 / 3, abs=1e-3)
    ref = section(spark, x, ["A" if i % 3 == 0 else "B" if i % 3 == 1 else "Cee cell" for i in range(120)])
    assert {r.ref_label: r.present for r in mk.reference_coverage(s.cells, ref.cells).collect()} == {"A": True, "B": True, "Cee cell": False}
