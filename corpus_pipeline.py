"""The corpus pipeline: toxicity, near-duplicates, repeated passages, personal data, packing.

STAGES lists (name, function) in order; each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All stages but the last return the columns of
``documents``; each works on all that its predecessor kept. n_chars follows the text where a stage changes it.
Decisions belong to rows: they are found again by id and text (and language, where it matters), null-safe, so a row
with a null id goes when it is rejected, and a clean row stays when another row of its id goes. Of rows with equal ids
(or none) and equal texts one leaves the near-duplicate stage. Rows with null ids are not linked with others there; rows
with null texts pass to packing, where a null text is the single end id. Different texts under one id are one node of
the near-duplicate graph (see neardup.py): a link of one of them to another document counts for all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplekit.llm import neardup, packing, pii, repeats, toxicity
from ripplekit.llm.common import stored, table, text_hash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: The stages train and iterate, which SQL cannot express; tests/llm holds each stage and run() against a version in
#: plain Python (the toxicity classifier's own scores are taken over).
ORACLE_SQL = None


def _matched(docs: DataFrame, listed: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose id, text and what else ``listed`` names is (not) among its rows; nulls are equal."""
    names = [c for c in listed.columns if c != "text_hash"]
    key = listed.select(F.struct("*").alias("key"))
    same = [F.col(f"docs.{c}").eqNullSafe(F.col(f"key.{c}")) for c in names]
    return (docs.alias("docs").join(key, [*same, text_hash("docs.text").eqNullSafe(F.col("key.text_hash"))], how)
            .select(*COLUMNS))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected rows go (thresholds by language)."""
    out = toxicity.scored(docs, table(spark, sf_dir, "labels"), row_keys=True)
    return _matched(docs, out.where("rejected").select("doc_id", "lang", "text_hash").distinct(), "left_anti")


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id, and one row of repeated ones."""
    out = stored(neardup.near_duplicates(docs, row_keys=True).select("doc_id", "text_hash", "kept"), "pipeline-decided")
    gone = out.where("not kept").select("doc_id", "text_hash").distinct()
    again = stored(out.where("kept").groupBy("doc_id", "text_hash").count().where("count > 1").drop("count"), "pipeline-again")
    if again.isEmpty():
        return _matched(docs, gone, "left_anti")
    # the other columns of the row that stays are the smallest ones
    one = (_matched(docs, again, "left_semi").groupBy("doc_id", text_hash().alias("text_hash"))
           .agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("row"))
           .select("doc_id", "row.text", "row.lang", "row.source", "row.n_chars"))
    return _matched(docs, gone.union(again), "left_anti").union(one.select(*COLUMNS))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long passages that occur more than once are cut out."""
    return repeats.cut_repeats(docs).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return _counted(pii.redacted(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences."""
    return packing.packed(docs)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


STAGES = [("toxicity", toxicity_stage), ("neardup", neardup_stage), ("repeats", repeats_stage), ("pii", pii_stage),
          ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``; the result of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
