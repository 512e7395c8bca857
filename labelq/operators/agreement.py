"""Agreement of two labellings. One aggregation makes the contingency table; every
score is a small plan over its rows, one for each pair of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelq.functions.scalar import choose2, log_factorial, plogp, share
from labelq.sources.section import labels


def contingency(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(truth, pred, n) of the rows of ``df``; a missing label is the label 'nan'."""
    return df.groupBy(labels(truth).alias("truth"), labels(pred).alias("pred")).agg(F.count("*").alias("n"))


def _with_margins(c: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy())
    return c.select("truth", "pred", "n", F.sum("n").over(Window.partitionBy("truth")).alias("a"), F.sum("n").over(Window.partitionBy("pred")).alias("b"), total.alias("total"))


def per_class(c: DataFrame) -> DataFrame:
    """(label, support, predicted, hits, precision, recall, f1) for all labels of either side; 0 where undefined."""
    sides = F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits"))))
    t = c.select(sides.alias("s")).select("s.*").groupBy("label").agg(*(F.sum(x).alias(x) for x in ("support", "predicted", "hits")))
    zero = F.lit(0.0)
    return t.select("*", share(F.col("hits"), F.col("predicted"), zero).alias("precision"), share(F.col("hits"), F.col("support"), zero).alias("recall"),
                    share(2 * F.col("hits"), F.col("support") + F.col("predicted"), zero).alias("f1"))


def class_scores(c: DataFrame) -> DataFrame:
    """One row: accuracy, balanced_accuracy (over labels of the truth), macro_f1, weighted_f1, precision_macro, recall_macro."""
    support = F.col("support")
    return per_class(c).agg(
        share(F.sum("hits"), F.sum(support)).alias("accuracy"), F.avg(F.when(support > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"),
        share(F.sum(F.col("f1") * support), F.sum(support)).alias("weighted_f1"), F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"))


def rand_index(c: DataFrame) -> DataFrame:
    """One row: ari, 1 where both partitions are trivially equal."""
    m = _with_margins(c)
    pairs = m.agg(F.sum(choose2(F.col("n"))).alias("s"), F.sum(F.col("n") * (F.col("a") - 1) / 2).alias("a"), F.sum(F.col("n") * (F.col("b") - 1) / 2).alias("b"), F.max("total").alias("t"))
    e = share(F.col("a") * F.col("b"), choose2(F.col("t")), F.lit(0.0))
    return pairs.select(share(F.col("s") - e, (F.col("a") + F.col("b")) / 2 - e, F.lit(1.0)).alias("ari"))


def _entropies(m: DataFrame) -> DataFrame:
    n, a, b, t = (F.col(x).cast("double") for x in ("n", "a", "b", "total"))
    return m.agg(F.sum(n / t * F.log(n * t / (a * b))).alias("mi"), (-F.sum(n / t * F.log(a / t))).alias("hu"), (-F.sum(n / t * F.log(b / t))).alias("hv"), F.max("total").alias("t"))


def normalized_information(c: DataFrame) -> DataFrame:
    """One row: nmi with the arithmetic mean of the entropies; 1 if both sides have one label."""
    e = _entropies(_with_margins(c))
    return e.select(share(F.greatest(F.col("mi"), F.lit(0.0)), (F.col("hu") + F.col("hv")) / 2, F.lit(1.0)).alias("nmi"))


#: Standard deviations around its mean that an expected count is summed over; beyond, terms vanish in double precision.
REACH = 40


def adjusted_information(c: DataFrame) -> DataFrame:
    """One row: ami. The expected information is summed over the counts that each pair of
    margins may have, in log space, near the mean of its hypergeometric distribution."""
    m = _with_margins(c)
    a = m.select("truth", "a", "total").distinct()
    b = m.select("pred", "b").distinct()
    # label pairs, not rows: one row for each pair of margins
    pairs = a.crossJoin(b)
    x, y, t = (F.col(k).cast("double") for k in ("a", "b", "total"))
    mean = x * y / t
    sd = F.sqrt(x * y * (t - x) * (t - y) / (t * t * F.greatest(t - 1, F.lit(1.0))))
    low = F.greatest(F.lit(1), F.col("a") + F.col("b") - F.col("total"), F.floor(mean - REACH * sd - REACH))
    high = F.least("a", "b", F.ceil(mean + REACH * sd + REACH))
    n = F.col("n").cast("double")
    f = log_factorial
    weight = f(F.col("a")) + f(F.col("b")) + f(F.col("total") - F.col("a")) + f(F.col("total") - F.col("b")) - f(F.col("total")) - f(F.col("n")) - f(F.col("a") - F.col("n")) - f(
        F.col("b") - F.col("n")) - f(F.col("total") - F.col("a") - F.col("b") + F.col("n"))
    terms = pairs.select("a", "b", "total", F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("n"))
    emi = terms.agg(F.coalesce(F.sum(n / t * F.log(t * n / (x * y)) * F.exp(weight)), F.lit(0.0)).alias("emi"))
    e = _entropies(m).crossJoin(emi)
    both = F.count_distinct("truth") + F.count_distinct("pred")
    e = e.crossJoin(m.agg(both.alias("kinds")))
    bottom = (F.col("hu") + F.col("hv")) / 2 - F.col("emi")
    return e.select(F.when(F.col("kinds") == 2, F.lit(1.0)).otherwise(share(F.col("mi") - F.col("emi"), bottom)).alias("ami"))


def kappa(c: DataFrame) -> DataFrame:
    """One row: kappa, NULL where the expected agreement is 1."""
    p = per_class(c).agg(F.sum("hits").cast("double").alias("h"), F.sum("support").cast("double").alias("t"), F.sum(F.col("support").cast("double") * F.col("predicted")).alias("e"))
    t = F.col("t")
    return p.select(share(F.col("h") / t - F.col("e") / (t * t), 1 - F.col("e") / (t * t)).alias("kappa"))


def element_similarity(c: DataFrame, alpha: float = 0.9) -> DataFrame:
    """One row: ecs, the element-centric similarity of two partitions. ``alpha`` cancels out
    for partitions without overlap and is taken for the sake of the signature."""
    n = F.col("n").cast("double")
    return _with_margins(c).agg((F.sum(n * n / F.greatest("a", "b")) / F.sum(n)).alias("ecs"))


def external_scores(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """One row with all twelve truth-based scores; per_class_f1 is a map."""
    c = contingency(df, truth, pred)
    out = class_scores(c)
    for part in (rand_index(c), adjusted_information(c), normalized_information(c), kappa(c), element_similarity(c)):
        out = out.crossJoin(part)
    return out.crossJoin(per_class(c).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "f1")))).alias("per_class_f1")))


def hierarchical_accuracy(df: DataFrame, hierarchy: DataFrame, truth: str = "truth", pred: str = "pred", partial: float = 0.5) -> DataFrame:
    """One row: full credit for the same label, ``partial`` for the same parent; a label
    without a parent is its own."""
    c = contingency(df, truth, pred)
    for side in ("truth", "pred"):
        c = c.join(hierarchy.select(F.col("leaf").alias(side), F.col("parent").alias(f"{side}_up")), side, "left").withColumn(f"{side}_up", F.coalesce(f"{side}_up", side))
    n, same, near = F.col("n"), F.col("truth") == F.col("pred"), F.col("truth_up") == F.col("pred_up")
    mean = lambda v: F.sum(v * n) / F.sum(n)
    return c.agg(mean(F.when(same, 1.0).when(near, partial).otherwise(0.0)).alias("hierarchical_accuracy"), mean(F.when(same, 1.0).otherwise(0.0)).alias("subtype_accuracy"),
                 mean(F.when(near, 1.0).otherwise(0.0)).alias("lineage_accuracy"))


def shares(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(label, q, p): share of each label in the truth and in the prediction."""
    t = per_class(contingency(df, truth, pred))
    w = Window.partitionBy()
    return t.select("label", (F.col("support") / F.sum("support").over(w)).alias("q"), (F.col("predicted") / F.sum("predicted").over(w)).alias("p"))


def js_divergence(p, q):
    """Jensen-Shannon divergence (natural logarithm) of two columns of shares, as an aggregate."""
    m = (p + q) / 2
    return F.greatest((F.sum(plogp(p)) + F.sum(plogp(q))) / 2 - F.sum(plogp(m)), F.lit(0.0))


def pearson(x, y):
    """Correlation of two columns as an aggregate; NULL where one is constant."""
    n = F.count("*")
    sx, sy = F.sum(x), F.sum(y)
    top = F.sum(x * y) - sx * sy / n
    vx, vy = F.sum(x * x) - sx * sx / n, F.sum(y * y) - sy * sy / n
    return F.when((F.max(x) > F.min(x)) & (F.max(y) > F.min(y)), top / F.sqrt(vx * vy))


def composition_accuracy(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """One row: l1, pearson (1 where undefined), jsd of global label shares, and both as maps."""
    p, q = F.col("p"), F.col("q")
    of = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("label"), c))))
    return shares(df, truth, pred).agg(F.sum(F.abs(p - q)).alias("l1"), F.coalesce(pearson(p, q), F.lit(1.0)).alias("pearson"), js_divergence(p, q).alias("jsd"), of(p).alias("predicted"), of(q).alias("true"))


def deconvolution(props: DataFrame) -> DataFrame:
    """One row: r2, jsd (mean distance over types), jsd_per_spot, rmse, pearson of predicted
    against true shares; props: (spot_id, type, p_true, p_pred), a full matrix. NULL shares are an error."""
    if props.where("p_true is null or p_pred is null").limit(1).count():
        raise ValueError("both matrices must hold every spot and type")
    t, p = F.col("p_true"), F.col("p_pred")

    def by(key):
        w = Window.partitionBy(key)
        x = props.withColumn("x", share(t, F.sum(t).over(w))).withColumn("y", share(p, F.sum(p).over(w)))
        js = F.when((F.count("x") > 0) & (F.count("y") > 0), F.sqrt(js_divergence(F.col("x"), F.col("y"))))  # no distance from a sum of 0
        return x.groupBy(key).agg(js.alias("js")).agg(F.avg("js").alias("js"))

    types = props.groupBy("type").agg(F.sum((t - p) * (t - p)).alias("sse"), (F.count("*") * F.var_pop(t)).alias("sst"), (F.max(t) > F.min(t)).alias("varies"), pearson(t, p).alias("r"))
    r2 = F.when(F.col("varies"), 1 - F.col("sse") / F.col("sst")).otherwise(F.when(F.col("sse") == 0, 1.0).otherwise(0.0))
    return types.agg(F.avg(r2).alias("r2"), F.avg("r").alias("pearson")).crossJoin(by("type").withColumnRenamed("js", "jsd")).crossJoin(by("spot_id").withColumnRenamed("js", "jsd_per_spot")).crossJoin(
        props.agg(F.sqrt(F.avg((t - p) * (t - p))).alias("rmse"))).select("r2", "jsd", "jsd_per_spot", "rmse", "pearson")
