"""The registered queries of this subpackage: thin digests of what its operators return."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, line_dedup, near_dups, packing, quality_model, quality_rules, token_counts, token_store, url_filter
from .scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark, sf_dir):
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), width=3, num=85, den=100)


def op2_token_store(spark, sf_dir):
    scratch = Scratch(spark, "op2")
    token_store.write_store(table(spark, sf_dir, "documents"), scratch.path("store"), scratch=scratch)
    return token_store.read_store(spark, scratch.path("store"), of=zlib.crc32).withColumnRenamed("ids", "ids_crc32")


def op3_url_filter(spark, sf_dir):
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op4_quality_model(spark, sf_dir):
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op7_chat_format(spark, sf_dir):
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    path = Scratch(spark, "op7").path("chats")
    chat.format_chats(rows, path)
    return chat.chat_digests(spark, path)


def op8_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


def op10_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_near_duplicates, op2_token_store, op3_url_filter, op4_quality_model, op5_packing, op6_token_counts, op7_chat_format, op8_decontamination, op9_quality_rules, op10_line_dedup)}


def oracle_sql() -> dict[str, str]:
    """None of these has an equivalent in SQL: each is tested against a plain version instead."""
    return {}
