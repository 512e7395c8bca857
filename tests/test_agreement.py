import itertools
import math

import numpy as np
import pytest

from labelq.operators import agreement as ag
from labelq.sources.section import hierarchy_from_dict


def pairs(spark, truth, pred):
    return spark.createDataFrame(list(zip(truth, pred)), "truth string, pred string")


def one(df):
    return df.first().asDict()


def test_perfect_labels_score_one(spark):
    y = list("aabbcc") * 5
    r = one(ag.external_scores(pairs(spark, y, y)))
    for k in ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1", "ari", "ami", "nmi", "kappa", "ecs"):
        assert r[k] == pytest.approx(1.0), k
    assert r["per_class_f1"] == {"a": 1.0, "b": 1.0, "c": 1.0}


def test_missed_rare_class_lowers_macro_scores(spark):
    truth = ["A"] * 90 + ["B"] * 10
    r = one(ag.external_scores(pairs(spark, truth, ["A"] * 100)))
    assert r["accuracy"] == pytest.approx(0.9)
    assert r["macro_f1"] < r["accuracy"]
    assert r["per_class_f1"]["B"] == 0.0
    assert r["balanced_accuracy"] == pytest.approx(0.5)


def test_kappa_is_null_when_chance_agreement_is_one(spark):
    assert one(ag.kappa(ag.contingency(pairs(spark, ["a"] * 4, ["a"] * 4))))["kappa"] is None


def test_single_cluster_on_both_sides(spark):
    c = ag.contingency(pairs(spark, ["a"] * 4, ["z"] * 4))
    assert one(ag.rand_index(c))["ari"] == 1.0
    assert one(ag.normalized_information(c))["nmi"] == 1.0
    assert one(ag.adjusted_information(c))["ami"] == 1.0


def test_missing_labels_pool_into_one(spark):
    c = {(r.truth, r.pred): r.n for r in ag.contingency(pairs(spark, [None, None, "a"], ["x", "x", None])).collect()}
    assert c == {("nan", "x"): 2, ("a", "nan"): 1}


def _by_hand(x, y):
    n = len(x)
    pairs_ = list(itertools.combinations(range(n), 2))
    a = sum(x[i] == x[j] and y[i] == y[j] for i, j in pairs_)
    sx, sy = sum(x[i] == x[j] for i, j in pairs_), sum(y[i] == y[j] for i, j in pairs_)
    e = sx * sy / len(pairs_)
    ari = (a - e) / ((sx + sy) / 2 - e)
    ecs = np.mean([sum(1 for j in range(n) if x[j] == x[i] and y[j] == y[i]) / max(x.count(x[i]), y.count(y[i])) for i in range(n)])
    return ari, ecs


@pytest.mark.parametrize("seed", range(3))
def test_against_definitions(spark, seed):
    g = np.random.default_rng(seed)
    x, y = g.choice(list("abc"), 40).tolist(), g.choice(list("uvwz"), 40).tolist()
    c = ag.contingency(pairs(spark, x, y))
    ari, ecs = _by_hand(x, y)
    assert one(ag.rand_index(c))["ari"] == pytest.approx(ari)
    assert one(ag.element_similarity(c))["ecs"] == pytest.approx(ecs)
    back = ag.contingency(pairs(spark, y, x))
    for f, k in ((ag.rand_index, "ari"), (ag.adjusted_information, "ami"), (ag.normalized_information, "nmi"), (ag.element_similarity, "ecs")):
        assert one(f(c))[k] == pytest.approx(one(f(back))[k])


def test_ami_of_imperfect_partitions(spark):
    """Expected information by enumeration of all permutations of a small labelling."""
    x, y = list("aabbb"), list("uuuvv")

    def mi(p, q):
        n = len(p)
        return sum(k / n * math.log(n * k / (p.count(u) * q.count(v))) for u in set(p) for v in set(q) if (k := sum(a == u and b == v for a, b in zip(p, q))))

    emi = np.mean([mi(x, list(q)) for q in itertools.permutations(y)])
    h = lambda p: -sum(p.count(u) / len(p) * math.log(p.count(u) / len(p)) for u in set(p))
    want = (mi(x, y) - emi) / ((h(x) + h(y)) / 2 - emi)
    assert one(ag.adjusted_information(ag.contingency(pairs(spark, x, y))))["ami"] == pytest.approx(want, abs=1e-9)


def test_hierarchical(spark):
    h = hierarchy_from_dict(spark, {"CD4": "T", "CD8": "T", "B1": "B"})
    r = one(ag.hierarchical_accuracy(pairs(spark, ["CD4", "CD8", "B1"], ["CD4", "CD4", "B1"]), h))
    assert r["hierarchical_accuracy"] == pytest.approx(2.5 / 3)
    assert r["subtype_accuracy"] == pytest.approx(2 / 3)
    assert r["lineage_accuracy"] == pytest.approx(1.0)
    r = one(ag.hierarchical_accuracy(pairs(spark, ["new"], ["new"]), h))
    assert r["lineage_accuracy"] == 1.0


def test_composition(spark):
    r = one(ag.composition_accuracy(pairs(spark, list("aab"), list("aba"))))
    assert r["l1"] == 0 and r["jsd"] == 0 and r["pearson"] == pytest.approx(1.0)
    r = one(ag.composition_accuracy(pairs(spark, ["a", "a"], ["b", "b"])))
    assert r["jsd"] == pytest.approx(math.log(2)) and r["l1"] == pytest.approx(2)


def test_deconvolution(spark):
    g = np.random.default_rng(0)
    m = g.dirichlet(np.ones(4), 30)
    rows_ = [(i, f"t{k}", float(m[i, k]), float(m[i, k])) for i in range(30) for k in range(4)]
    r = one(ag.deconvolution(spark.createDataFrame(rows_, "spot_id int, type string, p_true double, p_pred double")))
    assert r["r2"] == pytest.approx(1) and r["rmse"] == 0 and r["jsd"] == pytest.approx(0, abs=1e-6) and r["pearson"] == pytest.approx(1)
    with pytest.raises(ValueError):
        ag.deconvolution(spark.createDataFrame([(0, "t", 1.0, None)], "spot_id int, type string, p_true double, p_pred double"))
