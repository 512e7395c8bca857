"""Sections made of the relational test tables, for the registered queries.

counts: quantity of each part brand in an order (cells are orders, genes are brands);
labels: the order's priority; samples: the customer's region; two brands are controls.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelq.operators.pairwise import centroids, nearest
from labelq.operators.space import knn_edges
from labelq.sources.section import Section, hierarchy_from_dict, markers_from_dict

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
#: Four brands a priority; the last set names one of its brands twice.
MARKERS = {p: [f"Brand#{4 * k + j}" for j in range(1, 5)] for k, p in enumerate(PRIORITIES)}
MARKERS["5-LOW"] = [*MARKERS["5-LOW"], "Brand#20"]
HIERARCHY = {"1-URGENT": "hot", "2-HIGH": "hot", "3-MEDIUM": "cold", "4-NOT SPECIFIED": "cold"}
SPATIAL_K = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markers(spark: SparkSession) -> DataFrame:
    return markers_from_dict(spark, MARKERS)


def hierarchy(spark: SparkSession) -> DataFrame:
    return hierarchy_from_dict(spark, HIERARCHY)


def section(spark: SparkSession, sf_dir: str, half: int | None = None) -> Section:
    """All orders, or those whose key is ``half`` modulo two."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    cells = orders.join(customer, orders.o_custkey == customer.c_custkey, "left").join(nation, F.col("c_nationkey") == nation.n_nationkey, "left")
    vote = lambda k: F.when((F.col("o_orderkey") * 7 + k) % 8 == 0, F.lit("1-URGENT")).otherwise(F.col("o_orderpriority")).alias(f"m{k}")
    cells = cells.select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderpriority").alias("label"), F.col("n_regionkey").alias("sample"), (F.col("o_totalprice") / 1000).alias("cell_area"), vote(1), vote(2), vote(3))
    genes = part.select(F.col("p_brand").alias("gene")).distinct().select("gene", F.substring("gene", 7, 9).cast("int").alias("gene_idx"), F.col("gene").isin("Brand#24", "Brand#25").alias("control"))
    counts = line.join(part, line.l_partkey == part.p_partkey).groupBy(F.col("l_orderkey").alias("cell_id"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("value"))
    if half is not None:
        cells, counts = cells.where(F.col("cell_id") % 2 == half), counts.where(F.col("cell_id") % 2 == half)
    return Section(cells, genes, counts)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, vec) of the embeddings table."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))


def spatial_section(spark: SparkSession, sf_dir: str) -> Section:
    """Vectors as cells, their first two components as coordinates, and positive components from
    the third on as counts of 62 genes, the last six of them controls."""
    p = points(spark, sf_dir)
    cells = p.select(F.col("id").alias("cell_id"), "label", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))
    long = p.select(F.col("id").alias("cell_id"), F.posexplode("vec").alias("i", "v")).where("i >= 2")
    genes = spark.range(2, 64).select(F.concat(F.lit("d"), F.col("id")).alias("gene"), F.col("id").cast("int").alias("gene_idx"), (F.col("id") >= 58).alias("control"))
    counts = long.where("v > 0").select("cell_id", F.concat(F.lit("d"), F.col("i")).alias("gene"), F.col("v").alias("value"))
    s = Section(cells, genes, counts, embeddings=p.select(F.col("id").alias("cell_id"), "vec"))
    return replace(s, edges=knn_edges(cells, SPATIAL_K).persist())


def class_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, class, p, label): exp(-distance to the class centroid), normalised."""
    p = points(spark, sf_dir)
    c = centroids(p).select(F.col("label").alias("id"), "vec")
    n = c.count()
    d = nearest(p, c, n, same=False).select(F.col("id").alias("cell_id"), F.col("nbr").alias("class"), F.exp(-F.col("distance")).alias("e"))
    return d.withColumn("p", F.col("e") / F.sum("e").over(Window.partitionBy("cell_id"))).join(p.select(F.col("id").alias("cell_id"), "label"), "cell_id").select("cell_id", "class", F.round("p", 9).alias("p"), "label")


def proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spot_id, type, p_true, p_pred): per supplier the share of quantity and of lines of each part type."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    g = line.join(part, line.l_partkey == part.p_partkey).groupBy(F.col("l_suppkey").alias("spot_id"), F.col("p_type").alias("type")).agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    spots, types = g.select("spot_id").distinct(), g.select("type").distinct()
    total = g.groupBy("spot_id").agg(F.sum("q").alias("tq"), F.sum("n").alias("tn"))
    full = spots.crossJoin(types).join(g, ["spot_id", "type"], "left").join(total, "spot_id").fillna(0, ["q", "n"])
    return full.select("spot_id", "type", (F.col("q") / F.col("tq")).alias("p_true"), (F.col("n") / F.col("tn")).alias("p_pred"))
