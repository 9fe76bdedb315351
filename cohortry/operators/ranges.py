"""Set-form interval operators: overlap joins by buckets, and merging of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, low: str, high: str, other_low: str, other_high: str, width_days: int = 30, on: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Rows of left whose closed interval [low, high] overlaps one of right, without a nested loop.

    Each interval is listed under every bucket of width_days that it touches; a pair meets in its buckets and is
    taken in the first one they share, so none comes twice.  on: equality keys besides.  how: inner, left_semi
    or left_anti.  Null bounds meet nothing.  An interval longer than a bucket costs a row for each it touches,
    so the width should be near the usual length.
    """
    on = on or []
    day = lambda c: F.floor(F.unix_date(F.col(c).cast("date")) / width_days)
    spread = lambda df, a, b: df.withColumn("__bucket", F.explode(F.sequence(day(a), day(b))))
    other = spread(right.where(F.col(other_low) <= F.col(other_high)), other_low, other_high).withColumnsRenamed({c: f"__r_{c}" for c in on})
    if how != "inner":
        left = left.withColumn("__row", F.monotonically_increasing_id())
    rows = spread(left.where(F.col(low) <= F.col(high)), low, high)
    first = F.greatest(day(low), day(other_low))
    cond: Column = (rows["__bucket"] == other["__bucket"]) & (F.col(low) <= F.col(other_high)) & (F.col(other_low) <= F.col(high)) & (rows["__bucket"] == first)
    for c in on:
        cond = cond & (F.col(c) == F.col(f"__r_{c}"))
    if how == "inner":
        return rows.join(other, cond).drop("__bucket", *(f"__r_{c}" for c in on))
    # buckets of one row are joined back into one
    hits = rows.join(other, cond, "left_semi").select("__row").distinct()
    return left.join(hits, "__row", how).drop("__row")


def merge_intervals(df: DataFrame, keys: list[str], low: str, high: str, gap: str = "INTERVAL '0.001' SECOND") -> DataFrame:
    """Overlapping and meeting closed intervals of each key merged into one row: keys, low, high.

    A null bound drops out; an empty table stays empty.  The running maximum needs a key's rows in order, so one
    key's rows lie in one task, but only two columns of them.
    """
    w = Window.partitionBy(*keys).orderBy(low, high)
    before = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.where(F.col(low).isNotNull() & F.col(high).isNotNull()).select(*keys, low, high).withColumn("__new", F.when(before.isNull() | (F.col(low) > before + F.expr(gap)), 1).otherwise(0))
    rows = rows.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "__island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("__island")
