"""Reading, materialising and small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of text handed to Python at once; texts may be megabytes long.
BATCH_ROWS, BATCH_BYTES = 256, 32 << 20
#: A side is broadcast only when its checked size is below this many bytes.
BROADCAST_BYTES = 16 << 20
#: Links that one file of a step towards components holds.
PART_ROWS = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, so that long texts fit in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Folders that this driver has written to the shared one.
_WRITTEN: list[str] = []


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """A new folder that every executor can read, with its file system's name, within the one
    that spark.checkpoint.dir names. It goes when the application ends.

    Without that setting a run on one machine gets a temporary folder; a cluster is
    refused, since its executors would each write to a disk of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        root = tempfile.mkdtemp(prefix="labelq-")
        spark.conf.set("spark.checkpoint.dir", root)
    path, fs = _hadoop(spark, f"{root.rstrip('/')}/labelq-{uuid.uuid4().hex}")
    _WRITTEN.append(fs.makeQualified(path).toString())
    fs.deleteOnExit(path)
    return _WRITTEN[-1]


def clean(spark: SparkSession) -> None:
    """Delete what the operators have written to the shared folder. Results that were not
    written elsewhere cannot be read afterwards."""
    while _WRITTEN:
        path, fs = _hadoop(spark, _WRITTEN.pop())
        fs.delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and reread it: lineage ends there, and a
    lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._labelq_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_labelq_path", None)
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            p, fs = _hadoop(df.sparkSession, path)
            fs.delete(p, True)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast ``df`` when its counted size is within BROADCAST_BYTES; else leave
    the join to a shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def text_key(text_col) -> Column:
    """Digest of a text. With its id it names a document: ids may repeat or be missing."""
    return F.xxhash64(F.col(text_col).cast("string") if isinstance(text_col, str) else text_col.cast("string"))


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id and text digest are not in ``gone`` (id, key), where a null id
    equals a null id. ``gone`` is broadcast only where its number is counted to be small."""
    gone = materialise(gone.toDF("__id", "__key").distinct())
    same = docs[id_col].eqNullSafe(gone["__id"]) & (text_key(docs[text_col]) == gone["__key"])
    return docs.join(maybe_broadcast(gone, gone.count(), 48), same, "left_anti")


def only_first(docs: DataFrame, repeated: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each id and text digest in ``repeated`` (id, key); other rows
    stay as they are. Of rows that differ in further columns any one stays."""
    repeated = materialise(repeated.toDF("__id", "__key").distinct())
    n = repeated.count()
    if not n:
        return docs
    side = maybe_broadcast(repeated, n, 48)
    same = docs[id_col].eqNullSafe(side["__id"]) & (text_key(docs[text_col]) == side["__key"])
    one = docs.join(side, same, "left_semi").dropDuplicates([id_col, text_col])
    return docs.join(side, same, "left_anti").unionByName(one)


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (a long, b long).

    Alternating large-star and small-star steps; every step is a partial
    aggregation and a join, and its result is written to the shared folder. The
    smallest neighbours are written too, so that the join meets two plain exchanges
    and the partition of a node with very many edges can be split.
    Returns (node, root) for every node with an edge to another node.
    Self-loops and repeated edges change nothing; no edges give no rows."""
    def both(e):
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def tidy(e):
        return e.where("a <> b").distinct()

    def stamp(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def write(e, rows):  # few files and tasks for few rows
        return materialise(e.coalesce(max(4, -(-rows // PART_ROWS))))

    edges = materialise(tidy(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    seen = stamp(edges)
    while seen[0]:
        e, n = both(edges), seen[0]
        low = write(e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), n)
        large = tidy(e.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            low.where("m < a").select("a", F.col("m").alias("b"))))
        large, old = write(large, n), [edges, low]
        low = write(large.groupBy("a").agg(F.min("b").alias("m")), n)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            low.select("a", F.col("m").alias("b")))
        edges = write(tidy(small), n)
        discard(*old, large, low)
        now = stamp(edges)
        if now == seen:
            break
        seen = now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
