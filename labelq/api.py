"""The metrics by their names: each function takes a Section (or label pairs) and returns
plain values, per-cell results being columns of the returned section.

Results that grow with the data stay DataFrames; dictionaries hold one entry a label at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelq.operators import agreement as ag
from labelq.operators import conformal as cf
from labelq.operators import embedding as em
from labelq.operators import markers as mk
from labelq.operators import signal as sg
from labelq.operators import space as sp
from labelq.operators import stochastic as st
from labelq.plans import report
from labelq.sources.section import Section, hierarchy_from_dict, markers_from_dict


def _one(df: DataFrame) -> dict:
    row = df.first()
    return row.asDict(recursive=True) if row is not None else {}


def _by(df: DataFrame, key: str) -> dict:
    return {r[key]: {k: v for k, v in r.asDict().items() if k != key} for r in df.collect()}


def _sets(section: Section, marker_sets) -> DataFrame:
    return marker_sets if isinstance(marker_sets, DataFrame) else markers_from_dict(section.cells.sparkSession, marker_sets)


def _mean(values) -> float | None:
    values = [v for v in values if v is not None]
    return sum(values) / len(values) if values else None


def _embedded(section: Section, embedding: DataFrame | None) -> Section:
    """The section with another embedding (cell_id, vec) in place of its own, if one is given."""
    return section if embedding is None else replace(section, embeddings=embedding)


def internal_validity(section: Section, k: int = 30, subsample: int = 2000, seed: int = 0, embedding: DataFrame | None = None) -> dict:
    return _one(em.internal_validity(em.points_of(_embedded(section, embedding)), k, subsample, seed))


def inter_sample_consistency(section: Section, sample_col: str, metric: str = "cosine") -> dict:
    per = _by(em.inter_sample_consistency(section, sample_col, metric), "label")
    if not per:
        return {"status": "skipped: fewer than 2 labels, or no label with 2 samples"}
    whole = per.pop(None)
    return {"consistency": whole["consistency"], "per_type": {t: v["consistency"] for t, v in per.items()}, "n_profiles": whole["n_profiles"]}


def marker_program_fidelity(section: Section, marker_sets) -> dict:
    per = _by(mk.marker_fidelity(section, _sets(section, marker_sets)), "set_name")
    return {"per_type": per, "mean_auc": _mean(v["auc"] for v in per.values()), "mean_cohens_d": _mean(v["cohens_d"] for v in per.values())}


def marker_gene_overlap(section: Section, marker_sets, n_top: int = 25) -> dict:
    per = _by(mk.marker_overlap(section, _sets(section, marker_sets), n_top), "set_name")
    return {"per_type": per, "mean_overlap": _mean(v["overlap"] for v in per.values())}


def avg_bio(section: Section, truth: str, embedding: DataFrame | None = None) -> dict:
    return _one(em.avg_bio(_embedded(section, embedding), truth))


def panel_resolvability(reference: Section, panel_genes: list[str] | DataFrame, target_depth: float = 50.0, **options) -> dict:
    spark = reference.cells.sparkSession
    genes = panel_genes if isinstance(panel_genes, DataFrame) else spark.createDataFrame([(g,) for g in panel_genes], "gene string")
    head, tiers = st.panel_resolvability(reference, genes, target_depth, **options)
    return _one(head) | {"per_type": {} if tiers is None else _by(tiers, "label")}


def external_scores(df: DataFrame, pred: str = "pred", truth: str = "truth") -> dict:
    return _one(ag.external_scores(df, truth, pred))


def element_centric_similarity(df: DataFrame, a: str, b: str, alpha: float = 0.9) -> float:
    return _one(ag.element_similarity(ag.contingency(df, a, b), alpha))["ecs"]


def hierarchical_accuracy(df: DataFrame, hierarchy: dict[str, str] | DataFrame, pred: str = "pred", truth: str = "truth", partial: float = 0.5) -> dict:
    h = hierarchy if isinstance(hierarchy, DataFrame) else hierarchy_from_dict(df.sparkSession, hierarchy)
    return _one(ag.hierarchical_accuracy(df, h, truth, pred, partial))


def composition_accuracy(df: DataFrame, pred: str = "pred", truth: str = "truth") -> dict:
    return _one(ag.composition_accuracy(df, truth, pred))


def deconvolution_metrics(props: DataFrame) -> dict:
    return _one(ag.deconvolution(props))


def _nested_index(row: dict, n_voters: int, has_markers: bool, has_reference: bool, cohort: dict | None, provenance: dict | None) -> dict:
    """The index's flat row as terms, abstention, coverage, cohort, flags and provenance."""
    if "aqi" not in row:
        return row
    by_markers = {c: row[c] for c in ("expected", "annotated_on_axis", "missing", "missing_frac")} if has_markers and row["missing_frac"] is not None else {}
    by_reference = {"reference_abundant": row["reference_abundant"], "missing_vs_reference": row["missing_vs_reference"], "n_ref_types_abundant": len(row["reference_abundant"])} if has_reference else {}
    flags = ("adequacy_unknown", "low_support", "abstention_available", "missing_lineages", "coverage_limited")
    return {
        **{c: row[c] for c in ("aqi", "aqi_core", "regime", "w_coh", "active_set", "argmin", "no_dict_frac")}, "n_ge50_types": row["n_big"],
        "components": {**{c.upper(): row[c] for c in ("a", "c", "g", "m", "h")}, "completeness": row["completeness"]},
        "abstention": {"signal": row["g"], "n_voters": n_voters, "available": row["abstention_available"]},
        "coverage": {**by_markers, **by_reference} or None, "cohort": cohort,
        "flags": {c: row[c] for c in flags} | {"missing_vs_reference": bool(row["missing_vs_reference"])},
        "provenance": {**(provenance or {}), "n_voters": n_voters},
    }


def annotation_quality_index(section: Section, marker_sets=None, *, cohort: dict | None = None, provenance: dict | None = None, **inputs) -> dict:
    """The index with its parts; ``cohort`` is what inter_sample_consistency() returns and is
    reported as it is. Further inputs are those of labelq.plans.report.quality_index()."""
    sets = _sets(section, marker_sets) if marker_sets else None
    voters = [v for v in inputs.get("voters", ()) if v in section.cells.columns]
    told = {c: cohort.get(c) for c in ("consistency", "per_type", "n_profiles")} if cohort and "consistency" in cohort else None
    row = _one(report.quality_index(section, sets, **inputs))
    return _nested_index(row, len(voters), sets is not None, inputs.get("reference") is not None, told, provenance)


def annotation_quality(section: Section, marker_sets=None, sample_col: str | None = None, k: int = 30, subsample: int = 5000, seed: int = 0,
                       compute_aqi: bool = True, embedding: DataFrame | None = None, provenance: dict | None = None, **inputs) -> dict:
    """The whole battery, each part in the shape that its own function gives it, or with a
    status where it cannot be computed. Cells and genes have to be listed once."""
    section.check_keys()
    parts = {"internal_validity": lambda: internal_validity(section, k, subsample, seed, embedding)}
    if marker_sets:
        parts["marker_fidelity"] = lambda: marker_program_fidelity(section, marker_sets)
    if sample_col is not None:
        parts["inter_sample_consistency"] = lambda: inter_sample_consistency(section, sample_col)
    out = {name: report.attempted(compute) for name, compute in parts.items()}
    if compute_aqi:
        whole = out["internal_validity"].get("integrated")
        known = section.cells.sparkSession.range(1).select(F.lit(whole).cast("double").alias("integrated"))
        stamp = {"reference": inputs.get("reference") is not None, "median_depth": inputs.get("median_depth"), **(provenance or {})}
        out["aqi"] = report.attempted(lambda: annotation_quality_index(section, marker_sets, validity=known, cohort=out.get("inter_sample_consistency"), provenance=stamp, **inputs))
    return out


def conformal_prediction_sets(proba_query: DataFrame, proba_cal: DataFrame, truth_cal: DataFrame, alpha: float = 0.1, class_conditional: bool = False, hierarchy=None, truth_query: DataFrame | None = None) -> dict:
    """sets: DataFrame (cell_id, labels, set_size, parents with a hierarchy); summary, and coverage with truth_query."""
    h = hierarchy_from_dict(proba_query.sparkSession, hierarchy) if isinstance(hierarchy, dict) else hierarchy
    sets = cf.prediction_sets(proba_query, proba_cal, truth_cal, alpha, class_conditional, h).persist()
    summary = _one(cf.set_summary(sets, truth_query)) | {"alpha": alpha, "class_conditional": class_conditional}
    out = {"sets": sets, "summary": summary}
    if truth_query is not None:
        out["coverage"] = summary["coverage"]
        out["per_type_coverage"] = {k: v["coverage"] for k, v in _by(cf.coverage_per_type(sets, truth_query), "label").items()}
    return out


def crisp_purity(section: Section, marker_sets) -> tuple[float, Section]:
    sets = _sets(section, marker_sets)
    return _one(mk.crisp_purity(section, sets))["crisp_purity"], section.with_columns(mk.crisp_cells(section, sets).select("cell_id", "crisp_impure"))


def mecr(section: Section, marker_sets) -> float:
    return _one(mk.mecr(section, _sets(section, marker_sets)))["mecr"]


def pmp(section: Section, marker_sets) -> Section:
    return section.with_columns(mk.pmp_cells(section, _sets(section, marker_sets)).select("cell_id", "pmp"))


def _no_shared_gene(section: Section, reference: Section | None, least: int) -> str | None:
    if reference is None:
        return "a second section is needed"
    n = section.genes.join(reference.genes.select("gene"), "gene", "left_semi").limit(least).count()
    return None if n >= least else f"the sections have {n} genes in common, {least} are needed"


def nmp(section: Section, reference: Section | None = None) -> tuple[dict, Section]:
    if reason := _no_shared_gene(section, reference, 1):
        return {"status": "skipped", "reason": reason}, section
    cells = mk.nmp_cells(section, reference)
    return {"status": "ok", "mean_nmp": cells.agg(F.avg("nmp")).first()[0]}, section.with_columns(cells)


def ncp(section: Section, reference: Section | None = None, coexpr_threshold: float = 0.1, max_genes: int = 400, max_pairs: int = 2000) -> dict:
    if reason := _no_shared_gene(section, reference, 2):
        return {"status": "skipped", "reason": reason}
    r = _one(mk.ncp(section, reference, coexpr_threshold, max_genes, max_pairs))
    return {"status": "ok", "ncp": r["ncp"]} if r["n_pairs"] else {"status": "skipped", "reason": "no pair of genes that the reference keeps apart"}


def _edges(section: Section, k: int) -> DataFrame:
    """The section's graph, which wins over ``k``, or the k nearest cells by x and y."""
    return section.edges if section.edges is not None else sp.knn_edges(section.cells, k)


def spatial_coherence(section: Section, k: int = 15, pas_threshold: float = 0.2) -> tuple[dict, Section]:
    edges = _edges(section, k)
    found = _one(sp.spatial_coherence(section.cells, edges, pas_threshold)) | {"k": k, "pas_threshold": pas_threshold}
    return found, section.with_columns(sp.coherence_cells(section.cells, edges))


def neighborhood_sanity(section: Section, n_neighs: int = 6, n_perms: int | None = None, seed: int = 0) -> dict:
    """By the exact permutation moments, or from ``n_perms`` random relabellings."""
    edges = _edges(section, n_neighs)
    z = sp.nhood_enrichment(section.cells, edges) if n_perms is None else sp.nhood_permuted(section.cells, edges, n_perms, seed)
    rows = sp.neighborhood_sanity(z).orderBy("label").collect()
    return {"categories": [r.label for r in rows], "self_enrichment": [r.self_z for r in rows],
            "suspicious": [{"type": r.label, "stronger_with": r.stronger_with, "self_z": r.self_z, "cross_z": r.cross_z} for r in rows if r.suspicious]}


def per_cell_confidence(section: Section, marker_sets, layer: str | None = None) -> tuple[dict, Section]:
    sets = _sets(section, marker_sets)
    cells = mk.marker_confidence(section.of_layer(layer), sets)
    n = mk.on_panel(sets, section.genes).select("set_name").distinct().count()
    return _one(cells.agg(F.avg("marker_margin").alias("mean_margin"), F.avg("marker_entropy").alias("mean_entropy"))) | {"n_sets": n}, section.with_columns(cells)


def label_stability(section: Section, annotate: Callable[[Section], DataFrame], drop_frac: float = 0.2, reps: int = 5, seed: int = 0, layer: str | None = None) -> tuple[dict, Section]:
    cells = st.label_stability(section.of_layer(layer), annotate, drop_frac, reps, seed)
    return {"mean_flip_rate": cells.agg(F.avg(1 - F.col("label_stability"))).first()[0], "reps": reps, "drop_frac": drop_frac}, section.with_columns(cells)


def moran_signal(section: Section, n_neighs: int = 6, genes: list[str] | None = None, n_perms: int | None = None, seed: int = 0) -> dict:
    """``n_perms`` and ``seed`` concern p-values, which are no part of the result, and change nothing."""
    per = sp.moran_genes(section, _edges(section, n_neighs))
    return _one(sp.moran_signal(per.where(F.col("gene").isin(genes)) if genes is not None else per))


def _written(section: Section, *columns: str) -> Section:
    return section.with_columns(sg.signal_cells(section).select("cell_id", *columns))


def signal_to_noise(section: Section) -> tuple[dict, Section]:
    if not section.genes.where("control").limit(1).count():
        return {"status": "skipped: none of the genes is a control"}, section
    return _one(sg.signal_to_noise(section)), _written(section, "mean_signal_ratio", "max_signal_ratio")


def sparsity(section: Section) -> tuple[dict, Section]:
    return _one(sg.sparsity(section)), _written(section, "sparsity")


def detection_entropy(section: Section) -> tuple[dict, Section]:
    return _one(sg.detection_entropy(section)), _written(section, "detection_entropy")


def tx_per_area(section: Section) -> tuple[dict, Section]:
    if "cell_area" not in section.cells.columns:
        return {"status": "skipped: cells without areas"}, section
    return _one(sg.tx_per_area(section)), _written(section, "tx_per_area")


#: What each part of the signal report asks of a section, and how it is computed.
SIGNAL_PARTS = {
    "sparsity": (lambda s: None, lambda s: sparsity(s)[0]),
    "detection_entropy": (lambda s: None, lambda s: detection_entropy(s)[0]),
    "signal_to_noise": (lambda s: None, lambda s: signal_to_noise(s)[0]),
    "tx_per_area": (lambda s: None, lambda s: tx_per_area(s)[0]),
    "moran": (lambda s: None if s.edges is not None or {"x", "y"} <= set(s.cells.columns) else "cells have no place", lambda s: moran_signal(s)),
}


def run_signal_qc(section: Section, do_moran: bool = True) -> dict:
    """The signal report: one entry for each part that the section can tell something about.
    A part that fails, be it at planning or at run time, is one with a status. Places are
    needed for ``moran``, which is otherwise left out. Cells and genes have to be listed once."""
    section.check_keys()
    due = {name: part for name, part in SIGNAL_PARTS.items() if (do_moran or name != "moran") and part[0](section) is None}
    return {name: report.attempted(lambda: compute(section)) for name, (_, compute) in due.items()}  # noqa: B023
