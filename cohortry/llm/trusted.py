"""Which documents a set of ids names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids are sent to all executors only if there are at most so many (8 bytes each); beyond it both sides are shuffled.
BROADCAST_IDS = 1_000_000


def flagged(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """docs with a boolean column name: whether its doc_id is among ids (one column doc_id; nulls match nothing)."""
    ids = ids.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("__id")).distinct()
    few = ids.count() <= BROADCAST_IDS
    hit = docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == F.col("__id"), "left")
    return hit.withColumn(name, F.col("__id").isNotNull()).drop("__id")
