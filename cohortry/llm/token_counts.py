"""Token counts through a digest cache.

A text is known by the SHA-256 of its content, a tokenizer by the digest of its vocabulary file and options.
Stored counts are joined on both; only distinct texts that the cache lacks are encoded, and their counts are
appended to it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .tokens import encoder, vocabulary

_CACHE = "tokenizer string, digest binary, n_tokens long"


def tokenizer_version(vocab: str) -> str:
    """Digest of the vocabulary file and of the way it is used."""
    with open(vocabulary(vocab), "rb") as f:
        return hashlib.sha256(f.read() + b"no added special tokens; no truncation; no padding").hexdigest()[:32]


def _count_rows(vocab: str):
    def rows(batches):
        enc = encoder(vocab)
        for b in batches:
            n = np.diff(enc.flat(b["text"])[1], prepend=0)
            yield pa.RecordBatch.from_arrays([b["digest"].cast(pa.binary()), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return rows


def token_counts(docs: DataFrame, vocab: str = "byte_bpe_50k.json", limit: int = 512, cache: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    cache: folder of the stored counts, made if there is none (without it the run has one of its own).  A null
    text is empty and has no tokens; repeated rows come out as often as they go in.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "token-counts")
    cache, version = cache or scratch.path("cache"), tokenizer_version(vocab)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    try:
        stored = spark.read.schema(_CACHE).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], _CACHE)
    own = stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    missing = rows.join(own, "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))
    counted = missing.mapInArrow(_count_rows(vocab), "digest binary, n_tokens long")
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    now = spark.read.schema(_CACHE).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    return rows.drop("text").join(now, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
