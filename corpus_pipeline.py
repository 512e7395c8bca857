"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark
decontamination and source mixing, each over all that the stage before kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``. The stages handle nulls, ties and empty tables as the operators'
docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelq.llm import common, decontam, langid, lines, mixing, simhash

#: Share of the way from a guess among the learned languages to certainty that a score has to go;
#: below it a document has no language that can be told. With four languages the bound is 0.4375.
CONFIDENCE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told: neither ``und`` nor nearer to a guess than CONFIDENCE."""
    found = langid.identify(docs)
    told = F.col("score") >= F.col("chance") + CONFIDENCE * (1 - F.col("chance"))
    return found.where((F.col("lang_pred") != langid.UND) & told).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take duplicate lines out of the texts; a document that loses all it had goes.
    n_chars becomes the length of what is left."""
    found = lines.dedup_lines(docs).where("n_removed = 0 or trim(kept) <> ''")
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)}
    changed = F.col("n_removed") > 0
    return found.select(*(F.when(changed, new[c]).otherwise(F.col(f"row.{c}")).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of texts linked at 0.8 of their five-word shingles: the
    one of smallest id. Documents are told apart by id and text."""
    return simhash.one_of_each(docs, find=simhash.near_texts)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark, told apart by id and text."""
    found = decontam.find_contaminated(docs, common.table(spark, sf_dir, "benchmark"))
    return common.without(docs, found.select("doc_id", "key"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with size, target of their source, words
    taken and the slot of the schedule that first takes any. Rows alike in id and text share the
    sum of their words; further columns of these names give way."""
    found = mixing.mix_sources(docs).taken.where("taken > 0").groupBy(F.col("doc_id").alias("t_id"), F.col("text_key").alias("t_key")).agg(
        F.sum("size").alias("size"), F.max("target").alias("target"), F.sum("taken").alias("taken"), F.min("first_slot").alias("first_slot"))
    own = docs.drop(*(c for c in found.columns if c in docs.columns))
    same = F.col("doc_id").eqNullSafe(F.col("t_id")) & (common.text_key("text") == F.col("t_key"))
    return own.join(found, same).drop("t_id", "t_key")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix)]

#: A learned classifier and 64-bit shingle hashes have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.materialise(docs)
    return docs
