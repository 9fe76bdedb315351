"""Quality classifier: random-indexing word vectors, pooled per document, and a small numpy network.

Words are hashed into BUCKETS; every bucket has a fixed sparse random index vector, and its word vector is the
sum of the index vectors of its neighbours over the whole corpus.  A document is the mean and the spread of the
unit vectors of its words.  A network with one hidden layer is fitted on a bounded sample of labelled rows, and
a temperature, fitted on rows that the network didn't see, makes its outputs probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import blocks

BUCKETS, DIM, NONZERO, REACH, SLICE = 1 << 15, 32, 4, 2, 512
#: The network is fitted on at most so many labelled rows, those with the least hash of doc_id.
SAMPLE, HIDDEN, EPOCHS, PREDICT_AT, FOLDS = 20_000, 32, 60, 0.3, 5
_rng = np.random.Generator(np.random.PCG64(31))
_SLOT = np.argsort(_rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
_SIGN = _rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def _vector_rows(batches):
    total = np.zeros(BUCKETS * DIM)
    for b in batches:
        for _, _, w in blocks(b["text"], block_bytes=4 << 20):
            k = (w.hash % np.uint64(BUCKETS)).astype(np.int64)
            for d in range(1, REACH + 1):
                if len(k) <= d:
                    continue
                same = np.flatnonzero(w.doc[:-d] == w.doc[d:])
                for one, other in ((k[same], k[same + d]), (k[same + d], k[same])):
                    for j in range(NONZERO):
                        total += np.bincount(one * DIM + _SLOT[other, j], _SIGN[other, j], minlength=BUCKETS * DIM)
    for s in range(BUCKETS // SLICE):
        part = total[s * SLICE * DIM : (s + 1) * SLICE * DIM]
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())], names=["slice", "part"])


def _sum_rows(batches):
    found: dict[int, np.ndarray] = {}
    for b in batches:
        for s, part in zip(b["slice"].to_pylist(), b["part"]):
            found[s] = found.get(s, 0) + np.frombuffer(part.as_py(), np.float32).astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], names=["slice", "part"])


def word_vectors(texts: DataFrame) -> np.ndarray:
    """BUCKETS unit vectors over all texts (one column text); buckets that never occur are zero."""
    schema = "slice int, part binary"
    parts = texts.select("text").mapInArrow(_vector_rows, schema).repartition(BUCKETS // SLICE, "slice").mapInArrow(_sum_rows, schema)
    out = np.zeros((BUCKETS, DIM))
    for r in parts.collect():  # a table of fixed size
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["part"]).reshape(-1, DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > 0, out / np.maximum(norm, 1e-12), 0)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, and the share of distinct words; zero without words."""
    out = np.zeros((len(texts), 2 * DIM + 1))
    for lo, hi, w in blocks(texts, block_bytes=1 << 19):
        k = (w.hash % np.uint64(BUCKETS)).astype(np.int64)
        x = vectors[k]
        n = np.maximum(w.count, 1)[:, None]
        total = np.concatenate([np.zeros((1, DIM)), np.cumsum(x, axis=0)])
        square = np.concatenate([np.zeros((1, DIM)), np.cumsum(x * x, axis=0)])
        mean = (total[w.first[1:]] - total[w.first[:-1]]) / n
        out[lo:hi, :DIM] = mean
        out[lo:hi, DIM : 2 * DIM] = np.sqrt(np.maximum((square[w.first[1:]] - square[w.first[:-1]]) / n - mean * mean, 0))
        order = np.lexsort((k, w.doc))
        new = np.append(True, (np.diff(k[order]) != 0) | (np.diff(w.doc[order]) != 0)) if len(k) else np.zeros(0, bool)
        out[lo:hi, -1] = np.bincount(w.doc[order][new], minlength=w.n) / n[:, 0]
    return np.round(out, 9)


class Network:
    """Two layers; fitted by Adam with fixed seeds, so equal inputs give equal weights."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.Generator(np.random.PCG64(5))
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        self.w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        order = rng.permutation(len(x))
        aside = order[: len(x) // 5]
        order = order[len(x) // 5 :] if len(x) >= 50 else order
        z = (x - self.mean) / self.std
        m, v, t = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        for _ in range(EPOCHS):
            rng.shuffle(order)
            for lo in range(0, len(order), 128):
                k = order[lo : lo + 128]
                h = np.maximum(z[k] @ self.w[0] + self.w[1], 0)
                p = 1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30)))
                e = (p - y[k]) / len(k)
                back = np.outer(e, self.w[2]) * (h > 0)
                t += 1
                for i, g in enumerate((z[k].T @ back + 1e-4 * self.w[0], back.sum(0), h.T @ e + 1e-4 * self.w[2], np.array([e.sum()]))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        if len(x) >= 50:
            logit, want = self.logit(x[aside]), y[aside]
            loss = lambda s: float(np.mean(np.logaddexp(0, np.where(want > 0, -1, 1) * logit / s)))
            self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.std @ self.w[0] + self.w[1], 0)
        return h @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def _feature_rows(shared):
    def rows(batches):
        for b in batches:
            x = pooled(b["text"], shared.value)
            yield pa.RecordBatch.from_arrays([b["quality"].cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["quality", "x"])

    return rows


def _score_rows(shared):
    def rows(batches):
        vectors, net = shared.value
        for b in batches:
            s = np.round(net.score(pooled(b["text"], vectors)), 9) if net else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), b["held_out"], pa.array(s)], names=["doc_id", "held_out", "score"])

    return rows


def held_out(column: str = "doc_id"):
    """Whether a row belongs to the fold that no label may be learned from; false without doc_id."""
    return F.coalesce(F.expr(f"crc32(cast(cast({column} as string) as binary)) % {FOLDS} = 0"), F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, predict_at: float = PREDICT_AT) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    docs needs doc_id and text, labels doc_id and quality (0 or 1; other rows and null ids are passed over, of
    contradicting rows the least counts).  Word vectors come from all texts; labels only from rows outside the
    held-out fold, at most sample of them; of rows that repeat an id the least text is learned from.  A null or wordless text is scored as a zero vector; without both
    labels every score is 0.5.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    vectors = word_vectors(docs)
    shared = spark.sparkContext.broadcast(vectors)
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.expr("xxhash64(doc_id)"), "doc_id").limit(sample)
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = texts.select("text", "quality").mapInArrow(_feature_rows(shared), "quality int, x binary")
    found = sorted((r["x"], r["quality"]) for r in rows.collect())  # a row for each of the sample at most
    y = np.array([q for _, q in found], float)
    net = Network(np.array([np.frombuffer(x) for x, _ in found]), y) if len(set(y.tolist())) == 2 else None
    out = docs.withColumn("held_out", held_out()).mapInArrow(_score_rows(spark.sparkContext.broadcast((vectors, net))), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= predict_at).cast("int"))


