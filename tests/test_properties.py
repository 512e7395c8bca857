"""Properties that hold for any input."""

import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from labelq.functions.ranks import accumulate, column_quantiles, quantiles
from labelq.functions.scalar import clip, log_factorial, r6, share
from labelq.operators import agreement as ag
from pyspark.sql import functions as F

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
label = st.one_of(st.none(), st.sampled_from(["a", "b", "c", "é"]))


@few
@given(rows=st.lists(st.tuples(label, label), min_size=2, max_size=40))
def test_scores_are_bounded_and_do_not_depend_on_names(spark, rows):
    c = ag.contingency(spark.createDataFrame(rows, "truth string, pred string")).cache()
    r = ag.rand_index(c).crossJoin(ag.normalized_information(c)).crossJoin(ag.element_similarity(c)).crossJoin(ag.class_scores(c)).first().asDict()
    assert -1 <= r["ari"] <= 1 + 1e-9 and -1e-9 <= r["nmi"] <= 1 + 1e-9 and 0 < r["ecs"] <= 1 + 1e-9
    assert all(0 <= r[k] <= 1 + 1e-9 for k in ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1", "precision_macro", "recall_macro"))
    renamed = c.withColumn("pred", F.concat(F.lit("x"), "pred"))
    s = ag.rand_index(renamed).crossJoin(ag.normalized_information(renamed)).crossJoin(ag.element_similarity(renamed)).first().asDict()
    assert all(math.isclose(r[k], s[k], abs_tol=1e-9) for k in s)


@few
@given(x=st.lists(st.one_of(st.none(), st.integers(-5, 5), st.floats(-1e6, 1e6)), min_size=1, max_size=60), p=st.sampled_from([0.0, 0.25, 0.5, 0.95, 1.0]))
def test_quantiles_match_numpy(spark, x, p):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in x], "v double")
    have = [float(v) for v in x if v is not None]
    got = quantiles(df, [], "v", {"q": p}).first().q
    assert got is None if not have else math.isclose(got, float(np.quantile(have, p)), rel_tol=1e-9, abs_tol=1e-9)
    assert column_quantiles(df, {"q": ("v", p)}).first().q == got


def test_ranks_over_buckets(spark):
    rows = [(g, float(v), 1 + v % 3) for g in "xy" for v in range(300)]
    got = accumulate(spark.createDataFrame(rows, "g string, v double, n long"), ["g"], "v").orderBy("g", "v").collect()
    want = np.cumsum([1 + v % 3 for v in range(300)]) - [1 + v % 3 for v in range(300)]
    assert [r.before for r in got] == [*want, *want]


def test_scalars(spark):
    n = [0, 1, 2, 5, 20, 170, 1000, 100000]
    got = [r.x for r in spark.createDataFrame([(v,) for v in n], "n long").select(log_factorial(F.col("n")).alias("x")).collect()]
    assert np.allclose(got, [math.lgamma(v + 1) for v in n], atol=1e-8, rtol=1e-12)
    r = spark.range(1).select(clip(F.lit(None).cast("double")).alias("a"), clip(F.lit(3.0)).alias("b"), share(F.lit(1), F.lit(0)).alias("c"), share(F.lit(1), F.lit(0), F.lit(7.0)).alias("d"), r6(F.lit(-1e-9)).alias("e")).first()
    assert r.a is None and r.b == 1.0 and r.c is None and r.d == 7.0 and math.copysign(1, r.e) == 1
