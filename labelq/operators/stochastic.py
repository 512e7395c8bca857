"""Thinning of counts, stability of labels under it, and what a panel can resolve.

Random draws are keyed on cell, repetition and seed, so that reruns and other
partitionings give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelq.operators import agreement
from labelq.sources.section import Section, labels


def thin(counts: DataFrame, keep: DataFrame, seed: int = 0) -> DataFrame:
    """(cell_id, gene, value): each unit of a whole count stays with the cell's probability;
    keep: (cell_id, keep). Counts are truncated to whole numbers; probability 1 leaves them so.

    Unit i stays if the first 32 bits of md5('seed:cell:gene:i') are below the probability."""
    x = counts.join(keep.select("cell_id", F.col("keep").cast("double").alias("keep")), "cell_id")
    least = F.lpad(F.lower(F.hex(F.floor(F.greatest(F.col("keep"), F.lit(0.0)) * 2.0 ** 32))), 8, "0")
    x = x.select("cell_id", "gene", "keep", F.col("value").cast("long").alias("n"), least.alias("least"), F.concat(F.lit(f"{seed}:"), F.col("cell_id").cast("string"), F.lit(":"), "gene", F.lit(":")).alias("unit"))
    stays = lambda i: F.substring(F.md5(F.concat("unit", i.cast("string"))), 1, 8) < F.col("least")
    drawn = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("n")), F.lit(0).cast("long"), lambda sum_, i: sum_ + stays(i).cast("long"))
    value = F.when(F.col("keep") >= 1, F.col("n")).when(F.col("n") > 0, drawn).otherwise(0)
    return x.select("cell_id", "gene", value.cast("double").alias("value")).where("value <> 0")


def label_stability(section: Section, annotate: Callable[[Section], DataFrame], drop_frac: float = 0.2, reps: int = 5, seed: int = 0) -> DataFrame:
    """(cell_id, label_stability): share of ``reps`` thinnings under which ``annotate``, a function
    from a section to (cell_id, label), keeps the label it gives to the full counts."""
    base = annotate(section).select("cell_id", labels().alias("base"))
    keep = section.cells.select("cell_id", F.lit(1.0 - max(0.0, drop_frac)).alias("keep"))
    flips = None
    for r in range(reps):  # ``reps`` plans of one union
        counts = thin(section.raw_or_counts, keep, seed * 1_000_003 + r)
        again = annotate(Section(section.cells, section.genes, counts, embeddings=section.embeddings, edges=section.edges)).select("cell_id", labels().alias("label"))
        one = base.join(again, "cell_id").select("cell_id", (F.col("base") != F.col("label")).cast("long").alias("flip"))
        flips = one if flips is None else flips.union(one)
    if flips is None:
        return section.cells.select("cell_id", F.lit(1.0).alias("label_stability"))
    return flips.groupBy("cell_id").agg((1 - F.sum("flip") / F.lit(max(1, reps))).alias("label_stability"))


def panel_predictions(reference: Section, panel_genes: DataFrame, target_depth: float = 50.0, max_cells_per_type: int = 250, cv: int = 3, seed: int = 0) -> DataFrame | None:
    """(truth, pred) of cross-validated multinomial regressions on the shared genes, after thinning
    whole counts to ``target_depth``; None below two labels of ten cells."""
    shared = reference.genes.join(panel_genes.select("gene"), "gene", "left_semi").select("gene", (F.row_number().over(Window.partitionBy().orderBy("gene_idx")) - 1).alias("pos"))
    g = shared.count()
    order = F.xxhash64(F.lit(seed), "cell_id")
    cells = reference.cells.select("cell_id", labels().alias("label"))
    w = Window.partitionBy("label").orderBy(order, "cell_id")
    picked = cells.withColumn("k", F.row_number().over(w)).where(F.col("k") <= max_cells_per_type)
    picked = picked.withColumn("of", F.count("*").over(Window.partitionBy("label"))).where("of >= 10").withColumn("fold", (F.col("k") % cv).cast("int")).cache()
    names = [r[0] for r in picked.select("label").distinct().orderBy("label").collect()]
    if len(names) < 2:
        return None
    counts = reference.counts.join(shared, "gene").join(picked.select("cell_id"), "cell_id", "left_semi")
    whole = counts.agg(F.max(F.abs(F.col("value") - F.round("value"))).alias("off"), F.max("value").alias("top")).first()
    raw = whole.off is not None and whole.off < 1e-8 and whole.top > 1
    if not raw and reference.raw is not None:
        counts, raw = reference.raw.join(shared, "gene").join(picked.select("cell_id"), "cell_id", "left_semi"), True
    x = counts.select("cell_id", "gene", F.col("value").cast("double").alias("value"))
    if raw:
        keep = x.groupBy("cell_id").agg(F.least(F.lit(1.0), F.lit(float(target_depth)) / F.greatest(F.sum("value"), F.lit(1.0))).alias("keep"))
        x = thin(x, keep, seed)
    lib = x.groupBy("cell_id").agg(F.sum("value").alias("lib"))
    v = x.join(lib, "cell_id").join(shared, "gene").select("cell_id", "pos", F.log1p(F.col("value") / F.when(F.col("lib") == 0, 1.0).otherwise(F.col("lib")) * 1e4).alias("v"))
    own = v.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("own"))
    at = F.transform(F.sequence(F.lit(0), F.lit(g - 1)), lambda i: F.coalesce(F.element_at("own", i), F.lit(0.0)))
    y = F.array_position(F.array(*map(F.lit, names)), F.col("label")) - 1
    data = picked.join(own, "cell_id", "left").select("fold", "label", array_to_vector(at).alias("features"), y.cast("double").alias("y")).cache()
    out = None
    for f in range(cv):
        train = data.where(F.col("fold") != f)
        lr = LogisticRegression(featuresCol="features", labelCol="y", family="multinomial", maxIter=300, tol=1e-8, regParam=1 / (0.3 * train.count()), elasticNetParam=0.0, standardization=False)
        pred = lr.fit(train).transform(data.where(F.col("fold") == f)).select(F.col("label").alias("truth"), F.element_at(F.array(*map(F.lit, names)), F.col("prediction").cast("int") + 1).alias("pred"))
        out = pred if out is None else out.union(pred)
    return out


def panel_tiers(c: DataFrame) -> DataFrame:
    """(label, f1, precision, recall, confused_with, confused_frac, tier) from a contingency table."""
    wrong = c.where("truth <> pred").groupBy(F.col("truth").alias("label")).agg(F.min(F.struct((-F.col("n")).alias("minus"), F.col("pred").alias("with"))).alias("w"))
    t = agreement.per_class(c).where("support > 0").join(wrong, "label", "left")
    frac = F.coalesce(-F.col("w.minus") / F.col("support"), F.lit(0.0))
    tier = F.when((F.col("f1") < 0.30) | (frac >= 0.30), "not_resolvable").when((F.col("f1") < 0.50) | (frac >= 0.25), "weak").otherwise("resolvable")
    return t.select("label", "f1", "precision", "recall", F.col("w.with").alias("confused_with"), F.round(frac, 2).alias("confused_frac"), tier.alias("tier"))


def panel_resolvability(reference: Section, panel_genes: DataFrame, target_depth: float = 50.0, max_cells_per_type: int = 250, cv: int = 3, seed: int = 0, least_genes: int = 25) -> tuple[DataFrame, DataFrame | None]:
    """One summary row (status, n_shared_genes, n_types, macro_f1, balanced_accuracy, ecs, frac_resolvable,
    frac_not_resolvable) and the tiers of each label, or None where the status is not 'ok'."""
    spark = reference.cells.sparkSession
    n = reference.genes.join(panel_genes.select("gene"), "gene", "left_semi").count()
    pred = panel_predictions(reference, panel_genes, target_depth, max_cells_per_type, cv, seed) if n >= least_genes else None
    if pred is None:
        status = "too_few_types" if n >= least_genes else "insufficient_overlap"
        return spark.range(1).select(F.lit(status).alias("status"), F.lit(n).cast("long").alias("n_shared_genes")), None
    c = agreement.contingency(pred).cache()
    tiers = panel_tiers(c)
    rate = lambda t: F.avg((F.col("tier") == t).cast("double")).alias(f"frac_{t}")
    head = agreement.class_scores(c).select("macro_f1", "balanced_accuracy").crossJoin(agreement.element_similarity(c)).crossJoin(tiers.agg(F.count("*").alias("n_types"), rate("resolvable"), rate("not_resolvable")))
    return head.select(F.lit("ok").alias("status"), F.lit(n).cast("long").alias("n_shared_genes"), "n_types", "macro_f1", "balanced_accuracy", "ecs", "frac_resolvable", "frac_not_resolvable"), tiers
