"""Signal quality without labels. One aggregation over the non-zero counts gives every
per-cell metric; headline figures are medians and shares over cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelq.functions.ranks import column_quantiles
from labelq.functions.scalar import clip, share
from labelq.sources.section import Section

EPS = 1e-9


def signal_cells(section: Section) -> DataFrame:
    """Per cell: total, n_detected, sparsity, detection_entropy, mean_signal_ratio and
    max_signal_ratio (NULL without control genes), tx_per_area (NULL without an area above 0)."""
    v = F.col("value").cast("double")
    g = section.genes.agg(F.sum((~F.coalesce("control", F.lit(False))).cast("long")).alias("n_genes"), F.sum(F.coalesce("control", F.lit(False)).cast("long")).alias("n_controls"))
    x = section.counts.join(section.genes.select("gene", F.coalesce("control", F.lit(False)).alias("control")), "gene")
    gene = ~F.col("control")
    per = x.groupBy("cell_id").agg(
        F.sum(v).alias("total"), F.sum((v > 0).cast("long")).alias("n_detected"), F.sum(F.when(v > 0, v * F.log(v)).otherwise(0.0)).alias("xlogx"),
        F.sum(F.when(gene, v).otherwise(0.0)).alias("gene_sum"), F.sum(F.when(gene, 0.0).otherwise(v)).alias("control_sum"), F.max(F.when(gene, v)).alias("gene_max"), F.sum(gene.cast("long")).alias("gene_nnz"))
    cells = section.cells
    for c in ("cell_area", "total_counts"):
        if c not in cells.columns:
            cells = cells.withColumn(c, F.lit(None).cast("double"))
    t = cells.select("cell_id", "cell_area", "total_counts").join(per, "cell_id", "left").fillna(0, ["total", "n_detected", "xlogx", "gene_sum", "control_sum", "gene_nnz"]).crossJoin(F.broadcast(g))  # one row
    entropy = F.log(F.when(F.col("total") > 0, F.col("total")).otherwise(1.0)) - F.col("xlogx") / F.when(F.col("total") > 0, F.col("total")).otherwise(1.0)
    scale = F.when(F.col("n_detected") > 1, F.log(F.col("n_detected").cast("double"))).otherwise(1.0)
    floor = share(F.col("control_sum"), F.col("n_controls"))
    top = F.when(F.col("gene_nnz") < F.col("n_genes"), F.greatest(F.coalesce("gene_max", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("gene_max"))
    ratio = lambda a: F.when(F.col("n_controls") > 0, F.log2((a + EPS) / (floor + EPS)))
    counts = F.coalesce(F.col("total_counts").cast("double"), F.col("total"))
    return t.select("cell_id", "total", "n_detected", (1 - F.col("n_detected") / (F.col("n_genes") + F.col("n_controls"))).alias("sparsity"), clip(entropy / scale).alias("detection_entropy"),
                    ratio(share(F.col("gene_sum"), F.col("n_genes"))).alias("mean_signal_ratio"), ratio(top).alias("max_signal_ratio"),
                    F.when(F.col("cell_area") > 0, counts / F.col("cell_area").cast("double")).alias("tx_per_area"))


#: Headline medians: name and per-cell column.
MEDIANS = {"median_cell_sparsity": "sparsity", "median_detection_entropy": "detection_entropy", "median_mean_signal_ratio": "mean_signal_ratio", "median_max_signal_ratio": "max_signal_ratio", "median_tx_per_area": "tx_per_area"}


def _medians(cells: DataFrame, *columns: str) -> DataFrame:
    return column_quantiles(cells, {name: (c, 0.5) for name, c in MEDIANS.items() if c in columns})


def _shares(cells: DataFrame) -> DataFrame:
    rate = lambda c: F.avg(c.cast("double"))
    return cells.agg(rate(F.col("detection_entropy") < 0.1).alias("frac_cells_single_gene_dominated"), rate(F.col("mean_signal_ratio") <= 0).alias("frac_cells_signal_below_control"))


def _zero_fraction(section: Section) -> DataFrame:
    nnz = section.counts.where("value <> 0").agg(F.count("*").alias("nnz"))
    size = section.cells.agg(F.count("*").alias("n")).crossJoin(section.genes.agg(F.count("*").alias("g")))
    return nnz.crossJoin(size).select((1 - share(F.col("nnz"), F.col("n") * F.col("g"))).alias("zero_fraction"))


def sparsity(section: Section) -> DataFrame:
    """One row: zero_fraction of the whole matrix and median_cell_sparsity."""
    return _zero_fraction(section).crossJoin(_medians(signal_cells(section).persist(), "sparsity"))


def detection_entropy(section: Section) -> DataFrame:
    """One row: median entropy, and the share of cells that one gene dominates (below 0.1)."""
    cells = signal_cells(section).persist()
    return _medians(cells, "detection_entropy").crossJoin(_shares(cells).select("frac_cells_single_gene_dominated"))


def signal_to_noise(section: Section) -> DataFrame:
    """One row: medians of both ratios, and the share of cells whose mean does not clear the controls'."""
    cells = signal_cells(section).persist()
    return _medians(cells, "mean_signal_ratio", "max_signal_ratio").crossJoin(_shares(cells).select("frac_cells_signal_below_control"))


def tx_per_area(section: Section) -> DataFrame:
    """One row: median counts per area over cells with an area."""
    return _medians(signal_cells(section).persist(), "tx_per_area")


def signal_summary(section: Section) -> DataFrame:
    """One row with all of the above; cells are read from one cached pass."""
    cells = signal_cells(section).persist()
    return _zero_fraction(section).crossJoin(_medians(cells, *MEDIANS.values())).crossJoin(_shares(cells))
