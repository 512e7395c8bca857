import math

import numpy as np
import pytest

from labelq.operators import conformal as cf


def long(spark, p, names, start=0):
    return spark.createDataFrame([(start + i, names[k], float(p[i, k])) for i in range(len(p)) for k in range(p.shape[1])], "cell_id long, class string, p double")


def make(n, seed, k=4, peak=0.9):
    g = np.random.default_rng(seed)
    y = g.integers(0, k, n)
    p = np.full((n, k), (1 - peak) / (k - 1)) + g.normal(0, 0.02, (n, k))
    p[np.arange(n), y] = peak + g.normal(0, 0.02, n)
    p = np.clip(p, 1e-3, None)
    return p / p.sum(1, keepdims=True), y


def truth(spark, y, names, start=0):
    return spark.createDataFrame([(start + i, names[v]) for i, v in enumerate(y)], "cell_id long, label string")


@pytest.mark.parametrize("n,alpha", [(1, 0.1), (9, 0.1), (10, 0.1), (57, 0.2), (200, 0.05)])
def test_threshold_is_the_higher_quantile(spark, n, alpha):
    g = np.random.default_rng(n)
    scores = np.round(g.random(n), 3)
    want = np.quantile(scores, min(1.0, math.ceil((n + 1) * (1 - alpha)) / n), method="higher")
    df = spark.createDataFrame([("a", float(s)) for s in scores], "class string, score double")
    got = cf.thresholds(df, df, alpha).first().qhat
    assert got == want and got == np.sort(scores)[cf.level_rank(n, alpha) - 1]


def test_coverage_and_sets(spark):
    names = list("ABCD")
    (pc, yc), (pq, yq) = make(150, 0), make(200, 1)
    sets = cf.prediction_sets(long(spark, pq, names), long(spark, pc, names), truth(spark, yc, names)).persist()
    s = cf.set_summary(sets, truth(spark, yq, names)).first()
    assert s.coverage >= 0.85 and s.pct_singleton > 0.8 and s.pct_singleton + s.pct_ambiguous + s.pct_empty_novel == pytest.approx(1)
    assert {r.label for r in cf.coverage_per_type(sets, truth(spark, yq, names)).collect()} == set(names)


def test_small_classes_use_the_common_threshold(spark):
    rows = [("a", i / 20) for i in range(20)] + [("b", 0.99)] * 3
    df = spark.createDataFrame(rows, "class string, score double")
    t = {r["class"]: r.qhat for r in cf.thresholds(df, df, 0.1, True).collect()}
    whole = cf.thresholds(df, df, 0.1).first().qhat
    assert t["b"] == whole and t["a"] == 19 / 20


def test_no_calibration_lets_all_in_and_unknown_labels_fail(spark):
    names = ["x", "y"]
    p = long(spark, np.array([[0.7, 0.3]]), names)
    none = spark.createDataFrame([], "cell_id long, label string")
    assert cf.prediction_sets(p, p, none).first().labels == names
    with pytest.raises(KeyError):
        cf.prediction_sets(p, p, truth(spark, [0], ["zzz"]))


def test_collapse_to_one_parent(spark):
    names = ["T1", "T2", "B"]
    cal = np.tile([0.5, 0.45, 0.05], (30, 1))
    h = spark.createDataFrame([("T1", "T"), ("T2", "T")], "leaf string, parent string")
    sets = cf.prediction_sets(long(spark, cal[:2], names), long(spark, cal, names), truth(spark, [1] * 30, names), hierarchy=h)
    assert [list(r.parents) for r in sets.collect()] == [["T"], ["T"]] and cf.set_summary(sets).first().pct_ambiguous_one_parent == 1.0
