"""The data model: a section of labelled cells over a gene panel, in long form.

cells (cell_id, label, ...), genes (gene, gene_idx, control), counts (cell_id, gene,
value) with non-zero values only, and optional raw counts, embeddings (cell_id, vec)
and neighbour edges (src, dst, weight). Zeros are implied by cells x genes.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NEED = {"cells": {"cell_id", "label"}, "genes": {"gene", "gene_idx", "control"}, "counts": {"cell_id", "gene", "value"},
         "raw": {"cell_id", "gene", "value"}, "embeddings": {"cell_id", "vec"}, "edges": {"src", "dst", "weight"}}


@dataclass(frozen=True)
class Section:
    cells: DataFrame
    genes: DataFrame | None = None
    counts: DataFrame | None = None
    raw: DataFrame | None = None          #: raw counts, when ``counts`` is not raw
    embeddings: DataFrame | None = None
    edges: DataFrame | None = None
    layers: dict[str, DataFrame] = field(default_factory=dict)  #: further counts by name

    def __post_init__(self):
        for part, need in _NEED.items():
            df = getattr(self, part)
            if df is not None and (lack := need - set(df.columns)):
                raise ValueError(f"{part} lacks {sorted(lack)}")
        for name, df in self.layers.items():
            if lack := _NEED["counts"] - set(df.columns):
                raise ValueError(f"layer {name} lacks {sorted(lack)}")

    @property
    def raw_or_counts(self) -> DataFrame:
        return self.counts if self.raw is None else self.raw

    def of_layer(self, name: str | None) -> "Section":
        """The section whose counts, raw ones too, are those of a layer; None: as it is."""
        if name is None:
            return self
        if name not in self.layers:
            raise ValueError(f"no layer {name!r}; there are {sorted(self.layers)}")
        return replace(self, counts=self.layers[name], raw=None)

    def check_keys(self) -> None:
        """Raise if a cell or a gene is listed twice (one aggregation each)."""
        for df, key in ((self.cells, "cell_id"), (self.genes, "gene")):
            if df is not None and df.groupBy(key).count().where("count > 1").limit(1).count():
                raise ValueError(f"{key} is not unique")

    def with_columns(self, found: DataFrame) -> "Section":
        """The section with per-cell results (cell_id, ...) as further columns of cells."""
        new = [c for c in found.columns if c != "cell_id"]
        return replace(self, cells=self.cells.drop(*new).join(found, "cell_id", "left"))


def labels(c: str = "label"):
    """Labels as text; a missing one is the label 'nan'."""
    return F.coalesce(F.col(c).cast("string"), F.lit("nan"))


def counts_from_columns(df: DataFrame, id_col: str, genes: list[str]) -> DataFrame:
    """A wide matrix, one column a gene, as long non-zero counts."""
    pairs = F.array(*(F.struct(F.lit(g).alias("gene"), F.col(g).cast("double").alias("value")) for g in genes))
    return df.select(F.col(id_col).alias("cell_id"), F.explode(pairs).alias("p")).select("cell_id", "p.*").where("value <> 0")


def counts_from_arrays(df: DataFrame, id_col: str, array_col: str, genes: DataFrame) -> DataFrame:
    """A dense array a cell, in the order of gene_idx (from 0), as long non-zero counts."""
    long = df.select(F.col(id_col).alias("cell_id"), F.posexplode(array_col).alias("gene_idx", "value")).where("value <> 0")
    return long.join(genes.select("gene", "gene_idx"), "gene_idx").select("cell_id", "gene", F.col("value").cast("double").alias("value"))


def markers_from_dict(spark: SparkSession, sets: dict[str, list[str]]) -> DataFrame:
    """(set_name, gene, pos); repeated genes stay."""
    return spark.createDataFrame([(s, g, k) for s, genes in sets.items() for k, g in enumerate(genes)], "set_name string, gene string, pos int")


def hierarchy_from_dict(spark: SparkSession, parents: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(parents.items()), "leaf string, parent string")
