"""The corpus pipeline: quality rules, line dedup, near-duplicates, benchmark decontamination, packing.

Each stage takes the documents that the one before it kept.  The last returns one row per packed piece.

Null columns, null, empty and very long texts, repeated rows and an empty table pass every stage: rows without doc_id can't be
named by the rules, the near-duplicates or the benchmark and stay; a null or empty text has nothing to lose and stays, and packs
as its end id; repeated rows are one document to the line dedup and copies to the near-duplicates.  Extra columns stay, whatever
their names, to the last stage but one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.decontaminate import decontaminate
from cohortry.llm.line_dedup import dedup_lines
from cohortry.llm.near_dups import keep_one
from cohortry.llm.packing import pack
from cohortry.llm.quality_rules import quality_rules
from cohortry.llm.scratch import Scratch


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; rows without doc_id can't be named by the rules and stay."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    judged = quality_rules(docs, trusted)
    lost = judged.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(docs.columns)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document that lost lines and has no word left goes, its lines stand elsewhere."""
    out = dedup_lines(docs)
    gone = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kept = out.where(~F.coalesce(gone, F.lit(False)))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more)."""
    return keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence."""
    return pack(docs)


STAGES = [("quality rules", rules_stage), ("line dedup", lines_stage), ("near duplicates", near_stage), ("decontamination", benchmark_stage), ("packing", packing_stage)]
#: The stages have no equivalent in SQL; they are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        scratch.drop(f"stage-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
