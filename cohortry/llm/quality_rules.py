"""Quality rules: base statistics, and a hashed n-gram log-likelihood ratio.

Words and word pairs of every document are hashed into BUCKETS counts: one multinomial over all documents
(raw), one over the trusted ones (target).  A document's score is the mean, over its words and word pairs, of
log p(target) - log p(raw), with add-SMOOTH counts.  A document's own grams are taken out of both counts first,
or rare words would speak for trusted documents and against all others.  A document is kept if its base
statistics are in order and its score reaches the threshold.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .trusted import flagged
from .words import Words, blocks, hash_runs, sums

BUCKETS, SMOOTH, THRESHOLD = 1 << 16, 2.0, -0.15
MIN_WORDS, REPEAT_WINDOW, REPEAT_SHARE = 20, 8, 30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _buckets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every word and word pair."""
    pair, at = w.grams(2)
    return (np.concatenate([w.hash, pair]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([w.doc, w.doc[at]])


def base_statistics(w: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document of a block."""
    lead = (w.data & 0xC0) != 0x80  # bytes that begin a code point
    points = np.concatenate([[0], np.cumsum(lead)])
    word_chars = sums(points[w.end] - points[w.start], w.first)
    n_symbols = sums(_SYMBOL[w.data], w.bounds)
    # lines: from a document's start or a line feed to the next; those with a word are hashed whole
    feed = np.flatnonzero(w.data == 10)
    begin = np.unique(np.concatenate([w.bounds[:-1], feed + 1]))
    begin = begin[begin < len(w.data)] if len(w.data) else begin[:0]
    stop = np.minimum(np.append(begin[1:], len(w.data)), len(w.data))
    doc = np.searchsorted(w.bounds, begin, "right") - 1
    stop = stop - ((stop > begin) & (w.data[np.maximum(stop - 1, 0)] == 10)) if len(begin) else stop
    has = np.searchsorted(w.start, stop) > np.searchsorted(w.start, begin)
    begin, stop, doc = begin[has], stop[has], doc[has]
    lens = stop - begin
    inside = np.zeros(len(w.data) + 1, np.int64)
    np.add.at(inside, begin, 1)
    np.add.at(inside, stop, -1)
    line = hash_runs(w.data[np.cumsum(inside)[:-1] > 0], lens)
    dup = np.zeros(w.n, np.int64)
    if len(line):
        order = np.lexsort((line, doc))
        same = (line[order][1:] == line[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        dup = np.bincount(doc[order][1:][same], minlength=w.n)
    gram, at = w.grams(REPEAT_WINDOW)
    repeat = np.zeros(w.n, np.int64)
    if len(gram):
        order = np.lexsort((gram, w.doc[at]))
        g, d = gram[order], w.doc[at][order]
        same = (g[1:] == g[:-1]) & (d[1:] == d[:-1])
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        cover = np.zeros(len(w.hash) + 1, np.int64)
        first = at[order][twice]
        np.add.at(cover, first, 1)
        np.add.at(cover, first + REPEAT_WINDOW, -1)
        repeat = sums(np.cumsum(cover)[:-1] > 0, w.first)
    return {"n_words": w.count, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": dup, "n_repeat_words": repeat}


def _count_rows(batches):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in batches:
        good = np.array(b["trusted"].to_pylist(), bool)
        for lo, hi, w in blocks(b["text"]):
            bucket, doc = _buckets(w)
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[good[lo:hi][doc]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def gram_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(raw, target) counts of the BUCKETS buckets over all of docs (doc_id, text, trusted)."""
    rows = docs.select("text", "trusted").mapInArrow(_count_rows, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows.collect():  # BUCKETS rows at most
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return raw, target


def scores(w: Words, trusted: np.ndarray, raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Mean log p(target) - log p(raw) of each document of a block, its own counts left out; 0 if nothing else is trusted."""
    bucket, doc = _buckets(w)
    key, own = np.unique(doc * BUCKETS + bucket, return_counts=True)
    bucket, doc = key % BUCKETS, key // BUCKETS
    n = np.bincount(doc, own, minlength=w.n)
    size_raw, size_target = raw.sum() - n, target.sum() - n * trusted
    p_target = (target[bucket] - own * trusted[doc] + SMOOTH) / (size_target[doc] + SMOOTH * BUCKETS)
    p_raw = (raw[bucket] - own + SMOOTH) / (size_raw[doc] + SMOOTH * BUCKETS)
    score = np.bincount(doc, own * np.log(p_target / p_raw), minlength=w.n) / np.maximum(n, 1)
    return np.where(size_target > 0, np.round(score, 9), 0.0)


_SCORED = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("score", pa.float64())])


def _score_rows(counts):
    def rows(batches):
        raw, target = counts.value
        for b in batches:
            ids, trusted = b["doc_id"].cast(pa.int64()), np.array(b["trusted"].to_pylist(), bool)
            for lo, hi, w in blocks(b["text"]):
                score = scores(w, trusted[lo:hi], raw, target)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *(pa.array(v.astype(np.int64)) for v in base_statistics(w).values()), pa.array(score)], schema=_SCORED)

    return rows


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    docs needs doc_id and text, trusted the doc_ids of trusted documents.  A null, empty or wordless text has
    zero statistics and score and fails the base; a row without doc_id is scored but never trusted; repeated
    rows are each counted.  Without any trusted document every score is 0.
    """
    spark = docs.sparkSession
    docs = flagged(docs.select("doc_id", "text"), trusted.select("doc_id"), "trusted")
    counts = spark.sparkContext.broadcast(gram_counts(docs))  # BUCKETS numbers twice
    out = docs.mapInArrow(_score_rows(counts), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


