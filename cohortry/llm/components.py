"""Connected components of a table of links, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: So few links are followed in one partition, where no step has to shuffle; more are dealt by key.
ONE_PART = 100_000


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, root) for every id in links (a, b): root is the least id that can be reached.

    Alternates large-star and small-star steps on the edge table until no edge changes; every step is a
    grouped minimum and a join on the node, so a node with very many links is pre-aggregated and its join can
    be split.  Up to ONE_PART links are one partition throughout.  Nulls in a or b and loops are ignored; an empty
    table gives an empty table.
    """
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    edges = scratch.keep(edges, f"{name}-0")
    few = edges.count() <= ONE_PART
    whole = lambda df: df.coalesce(1) if few else df
    seen, k = None, 0
    while True:
        k += 1
        edges = whole(edges)
        both = whole(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.where("u <> v").distinct()
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
        edges = scratch.keep(whole(small).where("u <> v").distinct(), f"{name}-{k}")
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(u, v) >> 20"))).head()
        if seen == now:
            break
        seen = now
    roots = whole(edges).select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.union(roots.select("root", "root").distinct()).toDF("id", "root")
