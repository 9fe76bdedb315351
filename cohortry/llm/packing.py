"""Packing by cutting-stock column generation.

A document's ids (with its end id) are cut into pieces of the full sequence length and one remainder.  Full
pieces are sequences of their own.  Remainders are counted by length class (lengths rounded up to a multiple
of GRID); the counts make a cutting-stock problem: a linear program over patterns of classes, whose columns
are priced by a knapsack dynamic program.  The rounded-down solution and first-fit patterns for what is left
give a table of patterns with multiplicities.  Pieces are ranked within their class, and a piece's rank names
its pattern, copy and place.  Only the counts (a fixed number of classes) reach the driver.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .tokens import encoder

SEQUENCE, GRID, END_ID = 1024, 8, 0


def _knapsack(value: np.ndarray, size: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Best multiset of items that fits the room; value and size by item."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fit = np.flatnonzero(size <= c)
        best[c], pick[c] = best[c - 1], -1
        if len(fit):
            total = value[fit] + best[c - size[fit]]
            k = int(total.argmax())
            if total[k] > best[c] + 1e-12:
                best[c], pick[c] = total[k], fit[k]
    out, c = np.zeros(len(value), np.int64), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[pick[c]] += 1
            c -= size[pick[c]]
    return float(best[room]), out


def cutting_stock(demand: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({size: pieces}, copies) that together hold exactly the demand {size: pieces}; sizes at most room."""
    sizes = np.array(sorted(s for s, n in demand.items() if n), np.int64)
    if not len(sizes):
        return []
    unit = int(np.gcd.reduce([*sizes, room]))
    if unit > 1:
        coarse = cutting_stock({s // unit: n for s, n in demand.items()}, room // unit)
        return [({s * unit: k for s, k in pattern.items()}, copies) for pattern, copies in coarse]
    want, m = np.array([demand[s] for s in sizes], float), len(sizes)
    columns = np.diag((room // sizes).astype(float))
    inverse, x = np.diag(1 / np.diag(columns)), want / (room // sizes)
    for _ in range(200 * m):
        dual = inverse.sum(0)
        gain, col = _knapsack(dual, sizes, room)
        if gain <= 1 + 1e-9:
            break
        way = inverse @ col
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(way > 1e-11, x / way, np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = x - step * way
        x[out] = step
        columns[:, out] = col
        row = inverse[out] / way[out]
        inverse = inverse - np.outer(way, row)
        inverse[out] = row
        x = np.maximum(x, 0)
    left, found = want.astype(np.int64), []
    for j in np.argsort(-x):
        col = columns[:, j].astype(np.int64)
        used = col > 0
        copies = min(int(np.floor(x[j] + 1e-9)), int((left[used] // col[used]).min())) if used.any() else 0
        if copies > 0:
            left = left - copies * col
            found.append(({int(sizes[i]): int(col[i]) for i in np.flatnonzero(col)}, copies))
    while left.any():  # what rounding left over: largest first, as many copies at once as it gives
        col, free = np.zeros(m, np.int64), room
        for i in range(m - 1, -1, -1):
            col[i] = min(left[i], free // sizes[i])
            free -= int(col[i] * sizes[i])
        used = col > 0
        copies = int((left[used] // col[used]).min())
        left = left - copies * col
        found.append(({int(sizes[i]): int(col[i]) for i in np.flatnonzero(col)}, copies))
    return found


def _piece_rows(vocab: str, end_id: int, room: int):
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("size", pa.int32()), ("part", pa.int32()), ("rank", pa.int64())])

    def rows(batches):
        from pyspark import TaskContext

        enc, part = encoder(vocab), TaskContext.get().partitionId()
        ranks: dict[int, int] = {}
        for b in (x for x in batches if x.num_rows):
            ids, ends = enc.flat(b["text"])
            raw, cols = memoryview(np.insert(ids, ends, end_id).astype("<u4", copy=False)).cast("B"), [[] for _ in schema]
            at = 0
            for doc, row, n in zip(b["doc_id"].to_pylist(), b["row"].to_pylist(), (np.diff(ends, prepend=0) + 1).tolist()):
                for s in range(0, n, room):
                    length = min(room, n - s)
                    size = room if length == room else min(-(-length // GRID) * GRID, room)
                    key = size if length < room else 0
                    rank = ranks.get(key, 0)
                    ranks[key] = rank + 1
                    for c, v in zip(cols, (doc, row, s, length, zlib.crc32(raw[4 * (at + s) : 4 * (at + s + length)]), n, key, part, rank)):
                        c.append(v)
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return rows


def pack(docs: DataFrame, vocab: str = "byte_bpe_50k.json", room: int = SEQUENCE, end_id: int = END_ID, scratch: Scratch | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs needs doc_id and text; a null or empty text is the end id alone.  Repeated rows and null doc_ids are
    packed like any other.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    pieces = scratch.keep(rows.mapInArrow(_piece_rows(vocab, end_id, room), "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long, size int, part int, rank long"), "pieces")
    counts = scratch.keep(pieces.groupBy("size", "part").agg(F.count("*").alias("n")), "counts")
    demand = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most room / GRID + 1 rows
    full = demand.pop(0, 0)
    places, base = [], full
    done: dict[int, int] = {}
    for pattern, copies in cutting_stock(demand, room):
        slot = 0
        for size, k in pattern.items():
            for _ in range(k):
                lo = done.get(size, 0)
                places.append((size, lo, lo + copies, base, slot))
                done[size], slot = lo + copies, slot + 1
        base += copies
    table = spark.createDataFrame([(0, 0, full, 0, 0), *places], "size int, lo long, hi long, base long, slot int")
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("size", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(bases, ["size", "part"]).withColumn("r", F.col("before") + F.col("rank"))
    # the intervals of a class: an array looked up by search, not a range join
    lists = table.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "base", "slot"))).alias("places"))
    found = ranked.join(F.broadcast(lists), "size").withColumn("p", F.expr("filter(places, x -> r >= x.lo AND r < x.hi)[0]"))
    placed = found.select("doc_id", "row", "start", "length", "ids_crc32", "doc_tokens", (F.col("p.base") + F.col("r") - F.col("p.lo")).alias("sequence_id"), F.col("p.slot").alias("slot"))
    within = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(within), F.lit(0)).alias("offset"))
