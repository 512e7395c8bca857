"""Marker evidence: do the labels fit the marker genes, and how pure are the cells?

markers: (set_name, gene, pos). Only genes on the panel count; a gene listed twice
counts twice where a score is a sum over the list. Plans touch non-zero counts only,
and zeros come in as group sizes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelq.functions.ranks import accumulate
from labelq.functions.scalar import clip, share
from labelq.sources.section import Section, labels


def on_panel(markers: DataFrame, genes: DataFrame) -> DataFrame:
    return markers.join(genes.select("gene"), "gene", "left_semi").select("set_name", "gene")


def _labelled(section: Section) -> DataFrame:
    return section.cells.select("cell_id", labels().alias("label"))


def set_loads(counts: DataFrame, panel: DataFrame) -> DataFrame:
    """(cell_id, set_name, load): sum over the set's genes, for cells that have any."""
    return counts.join(panel, "gene").groupBy("cell_id", "set_name").agg(F.sum(F.col("value").cast("double")).alias("load"))


def marker_fidelity(section: Section, markers: DataFrame) -> DataFrame:
    """(set_name, n, auc, cohens_d): does the set's load single out the cells labelled with it?
    NULL scores where no cell or every cell has the label; sets off the panel are missing."""
    panel = on_panel(markers, section.genes)
    cells = _labelled(section)
    loads = set_loads(section.counts, panel).join(cells, "cell_id")
    own = (F.col("label") == F.col("set_name")).cast("long")
    seen = loads.groupBy("set_name", "load").agg(F.count("*").alias("n"), F.sum(own).alias("p"))
    sizes = cells.groupBy("label").agg(F.count("*").alias("members"))
    sets = panel.select("set_name").distinct().crossJoin(cells.agg(F.count("*").alias("cells"))).join(sizes.withColumnRenamed("label", "set_name"), "set_name", "left").fillna(0, ["members"])
    tally = seen.groupBy("set_name").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    zero = sets.join(tally, "set_name", "left").select("set_name", F.lit(0.0).alias("load"), (F.col("cells") - F.coalesce("n", F.lit(0))).alias("n"), (F.col("members") - F.coalesce("p", F.lit(0))).alias("p"))
    v = seen.union(zero).groupBy("set_name", "load").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).where("n > 0")
    x, p, q = F.col("load"), F.col("p").cast("double"), (F.col("n") - F.col("p")).cast("double")
    t = accumulate(v, ["set_name"], "load").groupBy("set_name").agg(
        F.sum(p).alias("np"), F.sum(q).alias("nq"), F.sum(p * (F.col("before") + (F.col("n") + 1) / 2)).alias("ranks"),
        F.sum(p * x).alias("sp"), F.sum(q * x).alias("sq"), F.sum(p * x * x).alias("pp"), F.sum(q * x * x).alias("qq"))
    a, b = F.col("np"), F.col("nq")
    both = (a > 0) & (b > 0)
    num = (F.col("pp") - F.col("sp") * F.col("sp") / a) + (F.col("qq") - F.col("sq") * F.col("sq") / b)
    sd = F.sqrt(F.greatest(num, F.lit(0.0)) / F.greatest(F.lit(1.0), a + b - 2))
    gap = F.col("sp") / a - F.col("sq") / b
    return t.select("set_name", a.cast("long").alias("n"), F.when(both, (F.col("ranks") - a * (a + 1) / 2) / (a * b)).alias("auc"),
                    F.when(both, F.when((a < 2) | (b < 2), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(gap, sd), F.lit(0.0)))).alias("cohens_d"))


def marker_overlap(section: Section, markers: DataFrame, n_top: int = 25) -> DataFrame:
    """(set_name, n_curated, overlap): share of a set's genes among the ``n_top`` that stand out
    most in the cells of that label; ties go to the earlier gene. NULL below two cells in or out."""
    cells = _labelled(section)
    sizes = cells.groupBy("label").agg(F.count("*").alias("n_in"))
    by = section.counts.join(cells, "cell_id").groupBy("label", "gene").agg(F.sum(F.col("value").cast("double")).alias("s"), F.sum(F.col("value").cast("double") * F.col("value")).alias("ss"))
    whole = by.groupBy("gene").agg(F.sum("s").alias("all_s"), F.sum("ss").alias("all_ss"))
    sets = markers.select("set_name").distinct().join(sizes.withColumnRenamed("label", "set_name"), "set_name", "left").fillna(0, ["n_in"]).crossJoin(cells.agg(F.count("*").alias("n")))
    grid = sets.crossJoin(section.genes.select("gene", "gene_idx")).join(whole, "gene", "left").join(by.withColumnRenamed("label", "set_name"), ["set_name", "gene"], "left").fillna(0.0, ["s", "ss", "all_s", "all_ss"])
    n_in, n_out = F.col("n_in").cast("double"), (F.col("n") - F.col("n_in")).cast("double")
    mean_out = (F.col("all_s") - F.col("s")) / n_out
    score = (F.col("s") / n_in - mean_out) / F.sqrt(F.greatest((F.col("all_ss") - F.col("ss")) / n_out - mean_out * mean_out, F.lit(0.0)) + 1e-9)
    ok = (F.col("n_in") >= 2) & (F.col("n") - F.col("n_in") >= 2)
    ranked = grid.where(ok).withColumn("score", F.round(score, 12)).withColumn("k", F.row_number().over(Window.partitionBy("set_name").orderBy(F.desc("score"), "gene_idx")))
    top = ranked.where(F.col("k") <= n_top).select("set_name", "gene")
    curated = on_panel(markers, section.genes)
    n_cur = curated.groupBy("set_name").agg(F.count("*").alias("n_curated"))
    hits = top.join(curated.distinct(), ["set_name", "gene"]).groupBy("set_name").agg(F.count("*").alias("hits"))
    out = sets.join(n_cur, "set_name", "left").join(hits, "set_name", "left")
    return out.select("set_name", F.coalesce("n_curated", F.lit(0)).alias("n_curated"), F.when(ok, share(F.coalesce("hits", F.lit(0)), F.col("n_curated"))).alias("overlap"))


def _per_cell_scores(section: Section, loads: DataFrame, base: DataFrame) -> DataFrame:
    """(cell_id, scores): per cell an array of structs (score, set_name) over all sets of ``base``
    (set_name, base, size), where a cell without a load has the set's base."""
    sets = base.agg(F.sort_array(F.collect_list(F.struct("set_name", "base", "size"))).alias("sets"))
    own = loads.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("set_name", "load"))).alias("own"))
    rows = section.cells.select("cell_id").join(own, "cell_id", "left").crossJoin(F.broadcast(sets))  # one row
    score = lambda s: F.struct((s["base"] + F.coalesce(F.element_at("own", s["set_name"]), F.lit(0.0)) / s["size"]).alias("score"), s["set_name"].alias("set_name"))
    return rows.select("cell_id", F.transform("sets", score).alias("scores"))


def marker_confidence(section: Section, markers: DataFrame) -> DataFrame:
    """(cell_id, marker_margin, marker_entropy): best minus second-best mean set value, and the
    normalised entropy of their softmax; 0 and 1 with fewer than two sets on the panel."""
    panel = on_panel(markers, section.genes)
    sizes = panel.groupBy("set_name").agg(F.lit(0.0).alias("base"), F.count("*").cast("double").alias("size"))
    c = _per_cell_scores(section, set_loads(section.counts, panel), sizes)
    s = F.array_sort(F.transform("scores", lambda x: x["score"]))
    c = c.select("cell_id", s.alias("s"), F.size("scores").alias("k")).withColumn("top", F.element_at("s", -1))
    c = c.withColumn("total", F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    share_of = lambda x: F.exp(x - F.col("top")) / F.col("total")
    entropy = -F.aggregate("s", F.lit(0.0), lambda a, x: a + share_of(x) * F.log(F.greatest(share_of(x), F.lit(1e-12)))) / F.log(F.col("k").cast("double"))
    few = F.coalesce(F.col("k"), F.lit(0)) < 2
    return c.select("cell_id", F.when(few, 0.0).otherwise(F.col("top") - F.try_element_at("s", F.lit(-2))).alias("marker_margin"), F.when(few, 1.0).otherwise(entropy).alias("marker_entropy"))


def detections(counts: DataFrame, panel: DataFrame) -> DataFrame:
    """Distinct (cell_id, set_name): the cell has a positive count of one of the set's genes."""
    return counts.where("value > 0").join(panel, "gene").select("cell_id", "set_name").distinct()


def crisp_cells(section: Section, markers: DataFrame) -> DataFrame:
    """(cell_id, n_sets, crisp_impure): sets detected, and whether two or more are."""
    n = detections(section.counts, on_panel(markers, section.genes)).groupBy("cell_id").agg(F.count("*").alias("n_sets"))
    return section.cells.select("cell_id").join(n, "cell_id", "left").select("cell_id", F.coalesce("n_sets", F.lit(0)).alias("n_sets"), (F.coalesce("n_sets", F.lit(0)) >= 2).alias("crisp_impure"))


def crisp_purity(section: Section, markers: DataFrame) -> DataFrame:
    """One row: 1 - cells with two or more sets / cells with any; 1 where none has any."""
    c = crisp_cells(section, markers)
    return c.agg((1 - share(F.sum((F.col("n_sets") >= 2).cast("int")), F.sum((F.col("n_sets") >= 1).cast("int")), F.lit(0.0))).alias("crisp_purity"))


def mecr(section: Section, markers: DataFrame) -> DataFrame:
    """One row: mean over pairs of sets of cells with both / cells with either; 0 without a pair."""
    d = detections(section.counts, on_panel(markers, section.genes))
    n = d.groupBy("set_name").agg(F.count("*").alias("n"))
    b = d.select("cell_id", F.col("set_name").alias("other"))
    both = d.join(b, "cell_id").where("set_name < other").groupBy("set_name", "other").agg(F.count("*").alias("both"))
    m = n.select(F.col("set_name").alias("other"), F.col("n").alias("m"))
    pairs = n.join(m, F.col("set_name") < F.col("other")).join(both, ["set_name", "other"], "left").fillna(0, ["both"])
    return pairs.agg(F.coalesce(F.avg(share(F.col("both"), F.col("n") + F.col("m") - F.col("both"))), F.lit(0.0)).alias("mecr"))


def pmp_cells(section: Section, markers: DataFrame) -> DataFrame:
    """(cell_id, label, pmp): counts of the own label's markers / counts of all markers, NULL
    where the label has no marker on the panel or the cell no marker count."""
    panel = on_panel(markers, section.genes)
    times = panel.groupBy("set_name", "gene").agg(F.count("*").alias("times"))
    genes = panel.select("gene").distinct()
    cells = _labelled(section)
    hits = section.raw_or_counts.join(genes, "gene").join(cells, "cell_id")
    hits = hits.join(times, (hits.label == times.set_name) & (hits.gene == times.gene), "left")
    v = F.col("value").cast("double")
    sums = hits.groupBy("cell_id").agg(F.sum(v).alias("whole"), F.sum(v * F.coalesce("times", F.lit(0))).alias("own"))
    known = panel.select(F.col("set_name").alias("label"), F.lit(True).alias("known")).distinct()
    out = cells.join(sums, "cell_id", "left").join(known, "label", "left")
    return out.select("cell_id", "label", F.when(F.col("known"), clip(share(F.col("own"), F.col("whole")))).alias("pmp"))


def nmp_cells(section: Section, reference: Section) -> DataFrame:
    """(cell_id, nmp): share of the cell's counts on the tenth of the shared genes that the
    reference expresses least in its type (ties: the earlier gene); 0 for types it lacks."""
    shared = section.genes.select("gene", "gene_idx").join(reference.genes.select("gene"), "gene", "left_semi")
    ref_cells = _labelled(reference)
    sizes = ref_cells.groupBy("label").agg(F.count("*").alias("members"))
    sums = reference.counts.join(ref_cells, "cell_id").groupBy("label", "gene").agg(F.sum(F.col("value").cast("double")).alias("s"))
    grid = sizes.crossJoin(shared).join(sums, ["label", "gene"], "left").withColumn("mean", F.coalesce("s", F.lit(0.0)) / F.col("members"))
    w = Window.partitionBy("label")
    low = grid.withColumns({"k": F.row_number().over(w.orderBy("mean", "gene_idx")), "g": F.count("*").over(w)}).where(F.col("k") <= F.greatest(F.lit(1), F.ceil(F.col("g") * 0.1))).select("label", F.col("gene").alias("low_gene"))
    cells = _labelled(section)
    hits = section.raw_or_counts.join(shared.select("gene"), "gene", "left_semi").join(cells, "cell_id")
    hits = hits.join(low, (hits.label == low.label) & (hits.gene == F.col("low_gene")), "left").select("cell_id", F.col("value").cast("double").alias("v"), F.col("low_gene").isNotNull().alias("is_low"))
    per = hits.groupBy("cell_id").agg(F.sum("v").alias("whole"), F.sum(F.when(F.col("is_low"), F.col("v")).otherwise(0.0)).alias("low"))
    return cells.join(per, "cell_id", "left").select("cell_id", share(F.coalesce("low", F.lit(0.0)), F.col("whole"), F.lit(0.0)).alias("nmp"))


def co_detection(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """(i, j, both, either) for all pairs i < j of genes (gene, i); i runs from 0. Each task sums
    one square matrix over its cells, so rows out are pairs times tasks."""
    n = genes.count()
    cells = counts.where("value > 0").join(genes, "gene").groupBy("cell_id").agg(F.collect_set("i").alias("found"))

    def gram(batches):
        total = np.zeros((n, n), np.int64)
        for b in batches:
            hit = np.zeros((len(b), n))
            hit[np.repeat(np.arange(len(b)), [len(f) for f in b.found]), np.concatenate([*b.found, []]).astype(int)] = 1
            total += (hit.T @ hit).astype(np.int64)
        i, j = np.triu_indices(n)
        yield pd.DataFrame({"i": i, "j": j, "both": total[i, j]})

    m = cells.select("found").mapInPandas(gram, "i int, j int, both long").groupBy("i", "j").agg(F.sum("both").alias("both"))
    alone = m.where("i = j").select(F.col("i").alias("k"), F.col("both").alias("n"))
    x, y = alone.withColumnsRenamed({"k": "i", "n": "n_i"}), alone.withColumnsRenamed({"k": "j", "n": "n_j"})
    return m.where("i < j").join(x, "i").join(y, "j").select("i", "j", "both", (F.col("n_i") + F.col("n_j") - F.col("both")).alias("either"))


def ncp(section: Section, reference: Section, threshold: float = 0.1, max_genes: int = 400, max_pairs: int = 2000) -> DataFrame:
    """One row (n_pairs, ncp): of the gene pairs that the reference never or seldom shows in one
    cell, the share that the section keeps apart. The caps on genes and pairs are part of the
    metric's definition; ncp is NULL without a pair."""
    shared = section.genes.select("gene", "gene_idx").join(reference.genes.select("gene"), "gene", "left_semi")
    total = reference.counts.groupBy("gene").agg(F.sum(F.col("value").cast("double")).alias("s"))
    top = shared.join(total, "gene", "left").orderBy(F.coalesce("s", F.lit(0.0)).desc(), "gene_idx").limit(max_genes)
    genes = top.select("gene", (F.row_number().over(Window.partitionBy().orderBy("gene_idx")) - 1).alias("i")).cache()
    apart = co_detection(reference.counts, genes).where("either > 0").where(F.col("both") <= threshold * F.col("either")).orderBy("i", "j").limit(max_pairs).select("i", "j")
    now = co_detection(section.raw_or_counts, genes)
    kept = apart.join(now, ["i", "j"], "left").select((F.coalesce("either", F.lit(0)) == 0).alias("none"), (F.col("both") <= threshold * F.col("either")).alias("low"))
    return kept.agg(F.count("*").alias("n_pairs"), F.avg(F.when(F.col("none") | F.col("low"), 1.0).otherwise(0.0)).alias("ncp"))


def lineage_calls(section: Section, markers: DataFrame, margin: float = 0.25) -> DataFrame:
    """(cell_id, set_name, confident): the set of highest mean z-score, and whether it leads the
    second by ``margin``; ties go to the set that sorts last."""
    panel = on_panel(markers, section.genes)
    n = section.cells.agg(F.count("*").cast("double").alias("n"))
    v = F.col("value").cast("double")
    sums = section.counts.groupBy("gene").agg(F.sum(v).alias("s"), F.sum(v * v).alias("ss"))
    stats = panel.select("gene").distinct().join(sums, "gene", "left").fillna(0.0, ["s", "ss"]).crossJoin(n)
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)))
    stats = stats.select("gene", mean.alias("mean"), F.when(sd > 0, sd).otherwise(1.0).alias("sd"))
    base = panel.join(stats, "gene").groupBy("set_name").agg((-F.sum(F.col("mean") / F.col("sd")) / F.count("*")).alias("base"), F.count("*").cast("double").alias("size"))
    scaled = section.counts.join(stats, "gene").select("cell_id", "gene", (v / F.col("sd")).alias("value"))
    c = _per_cell_scores(section, set_loads(scaled, panel), base)
    s = F.array_sort(F.transform("scores", lambda x: F.struct(F.round(x["score"], 9).alias("score"), x["set_name"].alias("set_name"))))
    c = c.select("cell_id", s.alias("s")).where(F.size("s") > 1)
    best, second = F.element_at("s", -1), F.element_at("s", -2)
    return c.select("cell_id", best["set_name"].alias("set_name"), (best["score"] - second["score"] >= margin).alias("confident"))


def lineage_coverage(section: Section, markers: DataFrame, abstained: Column | None = None, min_frac: float = 0.03, min_cells: int = 50, margin: float = 0.25) -> DataFrame:
    """(set_name, cells, expected, annotated, missing, missing_frac): sets that the expression
    supports in a real share of cells, and whether the labels use them; no rows below two sets.
    ``abstained``: a condition on ``label`` for labels that mean 'unknown'."""
    calls = lineage_calls(section, markers, margin)
    w = Window.partitionBy()
    sets = on_panel(markers, section.genes).select("set_name").distinct()
    n = calls.groupBy("set_name").agg(F.sum(F.col("confident").cast("long")).alias("cells"))
    t = sets.join(n, "set_name", "left").fillna(0, ["cells"]).withColumns({"sure": F.greatest(F.lit(1), F.sum("cells").over(w)), "sets": F.count("*").over(w)}).where("sets > 1")
    t = t.crossJoin(section.cells.agg(F.count("*").alias("all_cells")))
    used = _labelled(section).select("label").distinct()
    used = used.where(~abstained) if abstained is not None else used
    t = t.join(used.select(F.col("label").alias("set_name"), F.lit(True).alias("used")), "set_name", "left")
    expected = (F.col("cells") >= min_cells) | (F.col("cells") / F.col("sure") >= min_frac)
    t = t.select("set_name", "cells", expected.alias("expected"), F.coalesce("used", F.lit(False)).alias("annotated"), "all_cells")
    t = t.withColumn("missing", F.col("expected") & ~F.col("annotated"))
    return t.withColumn("missing_frac", F.round(F.sum(F.when(F.col("missing"), F.col("cells")).otherwise(0)).over(w) / F.col("all_cells"), 3)).drop("all_cells")


def reference_coverage(cells: DataFrame, reference_cells: DataFrame, tau: float = 0.03, abstained: Column | None = None) -> DataFrame:
    """(ref_label, share, present): labels with ``tau`` of the reference's cells or more, and whether
    a label of the section matches: equal, or one within the other, after folding case and marks."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    ref = reference_cells.groupBy(labels().alias("ref_label")).agg(F.count("*").alias("n"))
    ref = ref.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).where(F.col("share") >= tau).withColumn("r", plain(F.col("ref_label")))
    own = cells.select(labels().alias("label")).distinct()
    own = (own.where(~abstained) if abstained is not None else own).select(plain(F.col("label")).alias("l")).where("l <> ''").distinct()
    fits = (F.col("r") == F.col("l")) | ((F.length("r") >= 4) & (F.contains(F.col("l"), F.col("r")) | F.contains(F.col("r"), F.col("l"))))
    hit = ref.join(own, fits & (F.col("r") != ""), "left_semi").select("ref_label", F.lit(True).alias("present"))
    return ref.select("ref_label", "share").join(hit, "ref_label", "left").select("ref_label", "share", F.coalesce("present", F.lit(False)).alias("present"))
