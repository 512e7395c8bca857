"""Registered queries of the core engine and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelq.functions.scalar import r6
from labelq.operators import agreement as ag
from labelq.operators import conformal as cf
from labelq.operators import embedding as em
from labelq.operators import markers as mk
from labelq.operators import signal as sg
from labelq.operators import space as sp
from labelq.operators import stochastic as st
from labelq.oracles import ORACLES  # noqa: F401
from labelq.plans import report
from labelq.plans import standin as s
from labelq.sources.section import Section


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, so that two engines' sums compare equal."""
    return df.select(*(r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _pairs(spark, d):
    """truth: the priority; pred: the first voter."""
    return s.section(spark, d).cells.select(F.col("label").alias("truth"), F.col("m1").alias("pred"))


def _table(f):
    return lambda spark, d: rounded(f(ag.contingency(_pairs(spark, d))))


def _cells(f):
    return lambda spark, d: rounded(f(s.section(spark, d), s.markers(spark)))


def _signal(f):
    return lambda spark, d: rounded(f(s.section(spark, d)))


def _points(f):
    return lambda spark, d: rounded(f(s.points(spark, d)))


def external_scores(spark, d):
    return rounded(ag.external_scores(_pairs(spark, d)).drop("per_class_f1"))


def ecs_lineitem(spark, d):
    return rounded(ag.element_similarity(ag.contingency(s.table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")))


def hierarchical(spark, d):
    return rounded(ag.hierarchical_accuracy(_pairs(spark, d), s.hierarchy(spark)))


def composition(spark, d):
    return rounded(ag.composition_accuracy(_pairs(spark, d)).drop("predicted", "true"))


def composition_shares(spark, d):
    return rounded(ag.shares(_pairs(spark, d)))


def deconvolution(spark, d):
    return rounded(ag.deconvolution(s.proportions(spark, d)))


def fidelity_summary(spark, d):
    return rounded(mk.marker_fidelity(s.section(spark, d), s.markers(spark)).agg(F.avg("auc").alias("mean_auc"), F.avg("cohens_d").alias("mean_cohens_d")))


def overlap(spark, d):
    return rounded(mk.marker_overlap(s.section(spark, d), s.markers(spark), n_top=10))


def confidence_summary(spark, d):
    return rounded(mk.marker_confidence(s.section(spark, d), s.markers(spark)).agg(F.avg("marker_margin").alias("mean_margin"), F.avg("marker_entropy").alias("mean_entropy")))


def nmp(spark, d):
    return rounded(mk.nmp_cells(s.section(spark, d, 1), s.section(spark, d, 0)))


def ncp(spark, d):
    return rounded(mk.ncp(s.section(spark, d, 1), s.section(spark, d, 0), threshold=0.12))


def coverage(spark, d):
    """The last priority counts as an abstention, so that its lineage can go missing."""
    return rounded(mk.lineage_coverage(s.section(spark, d), s.markers(spark), F.col("label") == "5-LOW"))


def reference_coverage(spark, d):
    cells = s.section(spark, d, 1).cells.where("label <> '2-HIGH'")
    return rounded(mk.reference_coverage(cells, s.section(spark, d, 0).cells))


def knn_edges(spark, d):
    return rounded(sp.knn_edges(s.spatial_section(spark, d).cells, s.SPATIAL_K))


def coherence(spark, d):
    x = s.spatial_section(spark, d)
    return rounded(sp.spatial_coherence(x.cells, x.edges))


def coherence_cells(spark, d):
    x = s.spatial_section(spark, d)
    return rounded(sp.coherence_cells(x.cells, x.edges))


def moran_genes(spark, d):
    x = s.spatial_section(spark, d)
    return rounded(sp.moran_genes(x, x.edges))


def moran_signal(spark, d):
    x = s.spatial_section(spark, d)
    return rounded(sp.moran_signal(sp.moran_genes(x, x.edges)))


def nhood_counts(spark, d):
    x = s.spatial_section(spark, d)
    return sp.nhood_counts(x.cells, x.edges)


def nhood_expected(spark, d):
    x = s.spatial_section(spark, d)
    return rounded(sp.nhood_enrichment(x.cells, x.edges))


def sanity(spark, d):
    x = s.spatial_section(spark, d)
    return rounded(sp.neighborhood_sanity(sp.nhood_enrichment(x.cells, x.edges)))


def sanity_permuted(spark, d):
    x = s.spatial_section(spark, d)
    return rounded(sp.neighborhood_sanity(sp.nhood_permuted(x.cells, x.edges)))


def consistency(spark, d):
    return rounded(em.inter_sample_consistency(s.section(spark, d)))


def avg_bio(spark, d):
    """Labels: the vector's label modulo five; truth: the label."""
    p = s.points(spark, d)
    cells = p.select(F.col("id").alias("cell_id"), (F.col("label").cast("int") % 5).cast("string").alias("label"), F.col("label").alias("truth"))
    return rounded(em.avg_bio(Section(cells, embeddings=p.select(F.col("id").alias("cell_id"), "vec"))))


def _conformal(class_conditional=False, parents=False):
    def run(spark, d):
        p = s.class_probabilities(spark, d)
        cal, query = p.where("cell_id % 2 = 0"), p.where("cell_id % 2 = 1")
        truth = cal.select("cell_id", "label").distinct()
        up = p.select(F.col("class").alias("leaf"), F.when(F.col("class").cast("int") < 5, "low").otherwise("high").alias("parent")).distinct().where("leaf <> '9'") if parents else None
        sets = cf.prediction_sets(query.select("cell_id", "class", "p"), cal.select("cell_id", "class", "p"), truth, class_conditional=class_conditional, hierarchy=up)
        return sets, query.select("cell_id", "label").distinct()

    return run


def conformal_sets(spark, d):
    sets, _ = _conformal()(spark, d)
    return sets.select("cell_id", F.concat_ws(",", "labels").alias("labels"), F.col("set_size").cast("long").alias("set_size"))


def conformal_conditional(spark, d):
    sets, _ = _conformal(class_conditional=True)(spark, d)
    return sets.select("cell_id", F.concat_ws(",", "labels").alias("labels"), F.col("set_size").cast("long").alias("set_size"))


def conformal_summary(spark, d):
    sets, truth = _conformal(parents=True)(spark, d)
    return rounded(cf.set_summary(sets, truth))


def conformal_coverage(spark, d):
    sets, truth = _conformal()(spark, d)
    return rounded(cf.coverage_per_type(sets, truth))


def aqi(spark, d):
    t = report.quality_index(s.section(spark, d), s.markers(spark), voters=["m1", "m2", "m3"])
    lists = {"active_set", "missing", "missing_vs_reference"}
    t = t.select(*(F.concat_ws(",", c).alias(c) if c in lists else F.col(c) for c in t.columns))
    return rounded(t.drop("a", "h", "missing_vs_reference", "expected", "annotated_on_axis", "reference_abundant"))


def aqi_full(spark, d):
    """The index with every input: the last priority means 'unknown', the reference is one half of
    the orders, samples are a cohort; coherence and what the panel resolves are given figures."""
    x = s.section(spark, d)
    coherent = spark.range(1).select(F.lit(0.4).alias("integrated"))
    resolved = spark.range(1).select(F.lit(0.204).alias("macro_f1"), F.lit(5).alias("n_types"), F.lit(0.9).alias("frac_resolvable"))
    t = report.quality_index(x, s.markers(spark), coherent, s.section(spark, d, 0), voters=["m1", "m2", "m3"], abstained=["5-LOW"], cohort=em.inter_sample_consistency(x), resolvability=resolved)
    return rounded(t.select(*(F.concat_ws(",", c).alias(c) if kind.startswith("array") else F.col(c) for c, kind in t.dtypes)))


def signal_report(spark, d):
    return rounded(report.signal_report(s.section(spark, d)))


def ward(spark, d):
    return rounded(em.ward_propmatch(s.points(spark, d)))


def validity(spark, d):
    return rounded(em.internal_validity(s.points(spark, d)))


def pca(spark, d):
    return em.pca_fallback(s.section(spark, d))


def _panel(spark, d):
    x = s.section(spark, d)
    return st.panel_resolvability(x, x.genes.select("gene"))


def panel_summary(spark, d):
    return _panel(spark, d)[0]


def panel_tiers(spark, d):
    return _panel(spark, d)[1]


def annotate_by_markers(x: Section) -> DataFrame:
    """A label for each cell: the marker set of the highest load, ties by name; 'none' without any."""
    sets = s.markers(x.cells.sparkSession)
    loads = mk.set_loads(x.counts, mk.on_panel(sets, x.genes))
    best = loads.groupBy("cell_id").agg(F.min(F.struct((-F.col("load")).alias("minus"), "set_name")).alias("b"))
    return x.cells.select("cell_id").join(best, "cell_id", "left").select("cell_id", F.coalesce("b.set_name", F.lit("none")).alias("label"))


def label_stability(spark, d):
    return rounded(st.label_stability(s.section(spark, d), annotate_by_markers))


def flagship(spark, d):
    """The annotation-quality headline: the index, its terms and its flags."""
    return aqi(spark, d)


QUERIES = {
    "contingency": lambda spark, d: ag.contingency(_pairs(spark, d)),
    "accuracy_block": _table(ag.class_scores), "per_class_f1": _table(ag.per_class), "ari": _table(ag.rand_index), "nmi": _table(ag.normalized_information),
    "ami": _table(ag.adjusted_information), "kappa": _table(ag.kappa), "ecs": _table(ag.element_similarity), "ecs_lineitem": ecs_lineitem, "external_scores": external_scores,
    "hierarchical_accuracy": hierarchical, "composition_accuracy": composition, "composition_shares": composition_shares, "deconvolution": deconvolution,
    "marker_fidelity": _cells(mk.marker_fidelity), "marker_fidelity_summary": fidelity_summary, "marker_gene_overlap": overlap,
    "marker_confidence_cells": _cells(mk.marker_confidence), "marker_confidence_summary": confidence_summary,
    "crisp_cells": _cells(mk.crisp_cells), "crisp_purity": _cells(mk.crisp_purity), "mecr": _cells(mk.mecr), "pmp_cells": _cells(mk.pmp_cells), "nmp_cells": nmp, "ncp": ncp,
    "lineage_coverage": coverage, "reference_coverage": reference_coverage,
    "signal_cells": _signal(sg.signal_cells), "sparsity": _signal(sg.sparsity), "detection_entropy": _signal(sg.detection_entropy), "signal_to_noise": _signal(sg.signal_to_noise), "tx_per_area": _signal(sg.tx_per_area),
    "signal_report": signal_report, "knn_edges": knn_edges, "spatial_coherence": coherence, "spatial_coherence_cells": coherence_cells, "moran_genes": moran_genes, "moran_signal": moran_signal,
    "nhood_counts": nhood_counts, "nhood_expected": nhood_expected, "neighborhood_sanity": sanity, "neighborhood_sanity_permuted": sanity_permuted,
    "neighborhood_purity": _points(em.neighborhood_purity), "orbital_medoid": _points(em.orbital_medoid), "avg_similarity": _points(em.avg_similarity), "silhouettes": _points(em.silhouettes), "scatter_indices": _points(em.scatter_indices),
    "inter_sample_consistency": consistency, "avg_bio": avg_bio, "conformal_sets": conformal_sets, "conformal_class_conditional": conformal_conditional, "conformal_summary": conformal_summary, "conformal_coverage": conformal_coverage,
    "aqi": aqi, "aqi_full": aqi_full, "ward_propmatch": ward, "internal_validity": validity, "pca_fallback": pca, "panel_resolvability": panel_summary, "panel_tiers": panel_tiers, "label_stability": label_stability,
}
