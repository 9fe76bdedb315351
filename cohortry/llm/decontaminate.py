"""Benchmark decontamination: word pairs confirmed jointly, then Smith-Waterman alignment.

The score of a document and a test item is that of their best local alignment (match +1, mismatch and gap -1), so
single changed, added or missing words cost little.  An alignment of score s consists of runs of equal words
with an edit or more between each two, so it holds s - 1 pairs of successive words or more that stand on both sides, at
different places, within twice the item's words.  Where a document has that many of an item's pairs so close
together, the item is aligned with the words around; no other place can reach the score, however frequent or
rare the pairs are.
"""

from __future__ import annotations

from itertools import pairwise
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, blocks

#: Words to a seed; an item of one word is its own.
NGRAM = 2
#: A hit needs this share of the item's words as score, SURE at most and SOME at least (or the whole item).
SHARE, SURE, SOME = 0.5, 13, 8
#: Test items sent to all executors at once; more are taken in blocks.
BLOCK_BYTES = 16 << 20


def needed(m: int) -> float:
    """Least score of a hit with an item of m words."""
    return min(max(min(SHARE * m, SURE), SOME), m)


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """(score, end in words) of the best local alignment."""
    place = np.arange(len(words) + 1)
    row, best, end = np.zeros(len(words) + 1, np.int64), 0, 0
    for x in item:
        step = np.where(words == x, 1, -1)
        new = np.maximum(row - 1, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + step)
        row = np.maximum(np.maximum.accumulate(new + place) - place, 0)  # gaps along the row
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


class Items:
    """A block of test items: word hashes, and n-grams sorted by hash with the items that hold them."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, self.words, grams, owner, place = ids, [], [], [], []
        for _, _, w in blocks(pa.array(texts, pa.string()), lower=True):
            for d in range(w.n):
                h, k = w.hash[w.first[d] : w.first[d + 1]], len(self.words)
                self.words.append(h)
                one = Words.grams(_Only(h), min(NGRAM, len(h)))[0] if len(h) else np.zeros(0, np.uint64)
                grams.append(one)
                owner.append(np.full(len(one), k))
                place.append(np.arange(len(one)))
        self.gram = np.concatenate([*grams, np.zeros(0, np.uint64)])
        order = np.argsort(self.gram, kind="stable")
        self.gram = self.gram[order]
        self.owner = np.concatenate([*owner, np.zeros(0, np.int64)]).astype(np.int64)[order]
        self.place = np.concatenate([*place, np.zeros(0, np.int64)]).astype(np.int64)[order]
        self.size = np.array([len(h) for h in self.words], np.int64)
        #: n-grams that an alignment of the needed score holds at least
        self.least = np.array([max(ceil(needed(len(h))) - 1, 1) for h in self.words], np.int64)
        self.lengths = sorted({min(NGRAM, len(h)) for h in self.words if len(h)})

    def hits(self, w: Words, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in seeds, word) of each word of a block where one of the sorted hashes begins."""
        found, where = [], []
        for n in self.lengths:
            h, at = w.grams(n)
            k = np.searchsorted(seeds, h)
            k[k == len(seeds)] = 0
            ok = seeds[k] == h if len(seeds) else np.zeros(len(h), bool)
            found.append(k[ok])
            where.append(at[ok])
        return np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*where, np.zeros(0, np.int64)]).astype(np.int64)


class _Only:
    """Words of a single text, as grams() needs them."""

    def __init__(self, h: np.ndarray):
        self.hash, self.doc = h, np.zeros(len(h), np.int64)


_HIT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.int64()), ("item_words", pa.int64()), ("doc_word", pa.int64())])


def _regions(items: Items, at: np.ndarray, doc: np.ndarray, one: np.ndarray):
    """(document, item, first, last place) of the stretches that hold enough n-grams of an item close together; at, doc
    and one are the places, documents and positions in items.gram of all hits."""
    order = np.lexsort((at, items.owner[one], doc))
    at, doc, one = at[order], doc[order], one[order]
    item, place = items.owner[one], items.place[one]
    fresh = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(at) != 0)))
    until = np.append(fresh[1:], len(at))
    at, doc, item = at[fresh], doc[fresh], item[fresh]
    least, reach = items.least[item], 2 * items.size[item]
    far = np.arange(len(at)) + least - 1
    ok = far < len(at)
    far[~ok] = 0
    ok &= (doc[far] == doc) & (item[far] == item) & (at[far] - at <= reach)
    cover = np.bincount(np.flatnonzero(ok), minlength=len(at) + 1) - np.bincount(far[ok] + 1, minlength=len(at) + 1)
    held = np.flatnonzero(np.cumsum(cover[: len(at)]))
    if not len(held):
        return
    at, doc, item = at[held], doc[held], item[held]
    new = np.append(True, (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(at) > reach[held][1:]))
    for s, e in pairwise(np.append(np.flatnonzero(new), len(at)).tolist()):
        if len(np.unique(place[fresh[held[s]] : until[held[e - 1]]])) >= least[held[s]]:
            yield int(doc[s]), int(item[s]), int(at[s]), int(at[e - 1])


def _hit_rows(shared):
    def rows(batches):
        items = shared.value
        distinct, first, n = np.unique(items.gram, return_index=True, return_counts=True)
        for b in batches:
            out, ids = [], b["doc_id"].to_pylist()
            for lo, _, w in blocks(b["text"], lower=True):
                k, at = items.hits(w, distinct)
                if not len(k):
                    continue
                each = n[k]
                one = np.repeat(first[k] - np.cumsum(each) + each, each) + np.arange(each.sum())
                at = np.repeat(at, each)
                best: dict[tuple[int, int], tuple[int, int]] = {}
                for d, i, s, e in _regions(items, at, w.doc[at], one):
                    m = len(items.words[i])
                    a, z = max(s - 2 * m, int(w.first[d])), min(e + 2 * m, int(w.first[d + 1]))
                    score, end = align(items.words[i], w.hash[a:z])
                    if score >= needed(m) and score > best.get((d, i), (0, 0))[0]:
                        best[d, i] = score, a + end - int(w.first[d])
                out += [(ids[lo + d], items.ids[i], s, len(items.words[i]), e) for (d, i), (s, e) in best.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], schema=_HIT)

    return rows


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, score, item_words, doc_word (where the alignment ends).

    docs needs doc_id and text, benchmark item_id and text.  A-Z are lower-cased.  Null, empty and wordless
    texts on either side match nothing; items of fewer words than an n-gram are sought whole; repeated rows
    come out as often as they go in.
    """
    spark = docs.sparkSession
    docs, found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for ids, texts in _item_blocks(benchmark):
        items = Items(ids, texts)
        hits = docs.mapInArrow(_hit_rows(spark.sparkContext.broadcast(items)), "doc_id long, item_id long, score long, item_words long, doc_word long")
        found = hits if found is None else found.union(hits)
    return found if found is not None else spark.createDataFrame([], "doc_id long, item_id long, score long, item_words long, doc_word long")


def _item_blocks(benchmark: DataFrame):
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"])
        if size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents in which a test item was found; a row without doc_id is told apart by its text."""
    hits = contaminated(docs.select(F.expr("xxhash64(text, doc_id)").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__key")).distinct()
    return docs.withColumn("__key", F.expr("xxhash64(text, doc_id)")).join(hits, "__key", "left_anti").select(docs.columns)
