"""Composite reports: the annotation-quality index, the whole battery and the signal report.

A part that cannot be computed is NULL, or a row with a status, and never fails the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelq.functions.ranks import quantiles
from labelq.functions.scalar import clip, share
from labelq.operators import embedding, markers as mk, signal, space, stochastic
from labelq.sources.section import Section, labels


def purity_term(section: Section, markers: DataFrame, big: DataFrame) -> DataFrame:
    """One row: c, the smaller of the mean over big labels of the median pmp and of the share of
    their cells that have one; NULL without."""
    p = mk.pmp_cells(section, markers).join(big, "label", "left_semi")
    med = quantiles(p, ["label"], "pmp", {"m": 0.5}).agg(F.avg("m").alias("m"))
    kept = p.agg(share(F.count("pmp"), F.count("*")).alias("kept"))
    return med.crossJoin(kept).select(F.when(F.col("m").isNotNull(), clip(F.least("m", "kept"))).alias("c"))


def agreement_term(section: Section, voters: list[str], big: DataFrame) -> DataFrame:
    """One row: g, mean over big labels of the share of voters that back the label; NULL below three voters."""
    have = [v for v in voters if v in section.cells.columns]
    if len(have) < 3:
        return section.cells.sparkSession.range(1).select(F.lit(None).cast("double").alias("g"))
    backing = sum(((labels(v) == F.col("own")).cast("double") for v in have), F.lit(0.0)) / len(have)
    c = section.cells.withColumn("own", labels()).withColumn("backing", backing).join(big.withColumnRenamed("label", "own"), "own", "left_semi")
    return c.groupBy("own").agg(F.avg("backing").alias("b")).agg(clip(F.avg("b")).alias("g"))


def quality_index(section: Section, markers: DataFrame | None, validity: DataFrame | None = None, reference: Section | None = None, panel_genes: DataFrame | None = None,
                  median_depth: float | None = None, voters: list[str] = (), abstained: list[str] = (), cohort: DataFrame | None = None, min_type_n: int = 50, p_softmin: float = -4.0,
                  resolvability: DataFrame | None = None) -> DataFrame:
    """One row: aqi, aqi_core, regime, the terms a, c, g, m, h, completeness, w_coh, active_set,
    argmin, n_big, no_dict_frac, coverage lists and flags.

    The core is a soft minimum of purity (c) and marker fidelity (m), capped by what the panel
    can resolve at the section's depth (a) and scaled down by at most 15 % for incoherence (h).
    Agreement of voters (g), coverage and the cohort are reported and not scored.
    resolvability: the summary of panel_resolvability(), where it is at hand; else it is computed
    from the reference and the panel's genes."""
    spark = section.cells.sparkSession
    null = lambda name: spark.range(1).select(F.lit(None).cast("double").alias(name))
    unknown = F.col("label").isin(list(abstained)) if abstained else F.lit(False)
    cells = section.cells.select("cell_id", labels().alias("label"))
    big = cells.where(~unknown).groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= min_type_n).select("label", "n")
    names = big.select("label")

    resolv = null("frac_resolvable")
    a = null("a")
    if resolvability is None and reference is not None and panel_genes is not None:
        resolvability, _ = stochastic.panel_resolvability(reference, panel_genes, median_depth or 50.0)
    if resolvability is not None:
        head = resolvability
        if "macro_f1" in head.columns:
            a = head.select(F.when(F.col("n_types") >= 2, clip((F.col("macro_f1") - 1 / F.col("n_types")) / (1 - 1 / F.col("n_types")))).alias("a"))
            resolv = head.select("frac_resolvable")
    c = purity_term(section, markers, names) if markers is not None else null("c")
    m = null("m")
    if markers is not None:
        fid = mk.marker_fidelity(section, markers).join(names.withColumnRenamed("label", "set_name"), "set_name", "left_semi").where(F.col("n") >= min_type_n)
        m = fid.agg(F.avg("auc").alias("x")).select(F.when(F.col("x").isNotNull(), clip(2 * (F.col("x") - 0.5))).alias("m"))
    g = agreement_term(section, list(voters), names)
    h = validity.select(F.col("integrated").alias("h")) if validity is not None and "integrated" in validity.columns else null("h")
    typed = cells.agg(F.avg((~unknown).cast("double")).alias("typed"))
    sizes = big.agg(F.count("*").alias("n_big"), F.sum("n").alias("big_cells"))
    t = a.crossJoin(resolv).crossJoin(c).crossJoin(m).crossJoin(g).crossJoin(h).crossJoin(typed).crossJoin(sizes)

    if markers is not None:
        known = mk.on_panel(markers, section.genes).select(F.col("set_name").alias("label")).distinct()
        t = t.crossJoin(big.join(known, "label", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("dictless")))
        cover = mk.lineage_coverage(section, markers, unknown if abstained else None)
        t = t.crossJoin(cover.agg(F.sort_array(F.collect_list(F.when(F.col("missing"), F.col("set_name")))).alias("missing"), F.max("missing_frac").alias("missing_frac"),
                                  F.sort_array(F.collect_list(F.when(F.col("expected"), F.col("set_name")))).alias("expected"), F.sort_array(F.collect_list(F.when(F.col("annotated"), F.col("set_name")))).alias("annotated_on_axis")))
    else:
        t = t.select("*", F.lit(None).cast("long").alias("dictless"), F.array().cast("array<string>").alias("missing"), F.lit(None).cast("double").alias("missing_frac"),
                     *(F.array().cast("array<string>").alias(c) for c in ("expected", "annotated_on_axis")))
    lost = F.array().cast("array<string>")
    if reference is not None:
        ref = mk.reference_coverage(section.cells, reference.cells, abstained=unknown if abstained else None)
        t = t.crossJoin(ref.agg(F.sort_array(F.collect_list(F.when(~F.col("present"), F.col("ref_label")))).alias("missing_vs_reference"), F.sort_array(F.collect_list("ref_label")).alias("reference_abundant")))
    else:
        t = t.withColumns({"missing_vs_reference": lost, "reference_abundant": lost})

    C, M, A = F.col("c"), F.col("m"), F.col("a")
    unit = lambda x: clip(x, 0.01, 1.0)
    power = lambda x: F.coalesce(F.pow(unit(x), F.lit(p_softmin)), F.lit(0.0))
    terms = C.isNotNull().cast("int") + M.isNotNull().cast("int")
    t = t.withColumn("aqi_core", F.when(terms > 0, clip(F.pow((F.when(C.isNotNull(), power(C)).otherwise(0.0) + F.when(M.isNotNull(), power(M)).otherwise(0.0)) / terms, F.lit(1.0 / p_softmin)))))
    t = t.withColumn("w_coh", F.when(F.col("h").isNotNull(), clip(0.85 + 0.15 * F.col("h"), 0.85, 1.0)).otherwise(1.0))
    core = F.col("aqi_core")
    t = t.withColumn("aqi", F.when(core.isNotNull(), clip(F.col("w_coh") * F.least(core, F.coalesce(A, core)))))
    lower_m = M.isNotNull() & (C.isNull() | (unit(M) < unit(C)))
    argmin = F.when(core.isNull(), F.lit(None)).when(A.isNotNull() & (A < core), "panel/depth ceiling").when(lower_m, "marker fidelity").otherwise("contamination")
    names_of = F.array_compact(F.array(F.when(C.isNotNull(), "C"), F.when(M.isNotNull(), "M"), F.when(A.isNotNull(), "A")))
    no_dict = F.when(F.col("big_cells") > 0, F.round(F.col("dictless") / F.col("big_cells"), 3))
    out = t.select("aqi", "aqi_core", F.when(F.col("g").isNotNull(), "with_agreement").otherwise("index_only").alias("regime"), "a", "c", "g", "m", "h",
                   clip(F.coalesce(share(F.col("typed"), F.when(F.col("frac_resolvable") > 0, F.col("frac_resolvable"))), F.col("typed"))).alias("completeness"), "w_coh", names_of.alias("active_set"), argmin.alias("argmin"), "n_big",
                   no_dict.alias("no_dict_frac"), "expected", "annotated_on_axis", "missing", "missing_frac", "reference_abundant", "missing_vs_reference", A.isNull().alias("adequacy_unknown"), (F.col("n_big") < 2).alias("low_support"), F.col("g").isNotNull().alias("abstention_available"),
                   (F.size("missing") > 0).alias("missing_lineages"), F.coalesce(no_dict > 0.5, F.lit(False)).alias("coverage_limited"))
    if cohort is not None:
        out = out.crossJoin(cohort.where("label is null").agg(F.max("consistency").alias("cohort_consistency"), F.max("n_profiles").alias("cohort_profiles")))
    return out


def guarded(spark, make) -> DataFrame:
    """What ``make`` returns, or one row with the reason it could not be planned."""
    try:
        return make()
    except Exception as e:  # a report lists what it could not compute
        return spark.range(1).select(F.lit(f"skipped: {type(e).__name__}: {e}"[:500]).alias("status"))


def attempted(compute) -> dict:
    """What ``compute`` finds, or the reason why it found nothing; run to the end, so that
    failures of the jobs themselves are caught too."""
    try:
        return compute()
    except Exception as e:  # one part of a report never fails the rest
        return {"status": f"skipped: {type(e).__name__}: {e}"[:500]}


def annotation_quality(section: Section, markers: DataFrame | None = None, sample_col: str | None = None, k: int = 30, subsample: int = 5000, seed: int = 0, compute_aqi: bool = True, **inputs) -> dict[str, DataFrame]:
    """The whole battery: internal_validity, marker_fidelity, inter_sample_consistency and aqi."""
    spark = section.cells.sparkSession
    out = {}
    if section.embeddings is not None or section.counts is not None:
        out["internal_validity"] = guarded(spark, lambda: embedding.internal_validity(embedding.points_of(section), k, subsample, seed))
    if markers is not None:
        out["marker_fidelity"] = guarded(spark, lambda: mk.marker_fidelity(section, markers))
    if sample_col is not None:
        out["inter_sample_consistency"] = guarded(spark, lambda: embedding.inter_sample_consistency(section, sample_col))
    if compute_aqi:
        cohort = out.get("inter_sample_consistency")
        cohort = cohort if cohort is not None and "consistency" in cohort.columns else None
        out["aqi"] = guarded(spark, lambda: quality_index(section, markers, out.get("internal_validity"), cohort=cohort, **inputs))
    return out


def signal_report(section: Section, with_moran: bool = True) -> DataFrame:
    """One row with the headline figures of all signal metrics; Moran's where the section has edges."""
    out = signal.signal_summary(section)
    if with_moran and section.edges is not None:
        out = out.crossJoin(space.moran_signal(space.moran_genes(section, section.edges)))
    return out

