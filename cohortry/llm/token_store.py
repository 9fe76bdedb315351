"""Content-addressed token store.

A document's ids (with the end id) are cut into chunks where a rolling hash of the last ids has its low bits
zero, so equal passages give equal chunks wherever they stand.  A chunk is known by its digest and stored once:
with its only document, or, if several places hold it, with the first of them (in order of document), apart
from the inline chunks.  A document's recipe lists its chunks; its root is the Merkle root of their digests,
each segment's manifest line has the Merkle root of its documents (doc_id and root) in their order, and the top line that of the segments.
Reading holds all of it against what is there, and raises if a chunk, document, file or line is missing, repeated, moved or changed.
Documents stand in ascending order.

Layout below the store's folder: ``documents/`` (segment, doc_id, row, seg_start, n_tokens, recipe, ends, apart, inline,
shared, root), ``manifest/`` (segment, n_docs, n_tokens, root, seg_base) and ``top/`` (n_segments, n_docs, n_tokens, root).
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .tokens import encoder

END_ID, WINDOW, MASK, LEAST, MOST = 2, 8, 255, 64, 4096
_rng = np.random.Generator(np.random.PCG64(11))
_GEAR = _rng.integers(1, 2**63, 1 << 17, dtype=np.uint64)


def marks(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last WINDOW ids asks for a cut."""
    gear = _GEAR[ids & ((1 << 17) - 1)]
    h = gear.copy()
    for k in range(1, min(WINDOW, len(ids))):
        h[k:] += gear[:-k] << np.uint64(k)
    return np.flatnonzero((h >> np.uint64(20)) & np.uint64(MASK) == 0) + 1


def cuts(n: int, found: list[int]) -> list[int]:
    """Ends of the chunks of n ids: at the marks found, LEAST to MOST ids apart."""
    ends, last = [], 0
    for e in found:
        while e - last > MOST:
            last += MOST
            ends.append(last)
        if e - last >= LEAST and e < n:
            ends.append(e)
            last = e
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return [*ends, n]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; an odd node goes up as it is; no leaves give the digest of nothing."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@lru_cache(maxsize=1)
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def _pack(ids: bytes) -> bytes:
    """Compressed ids: 16 bits each where they fit."""
    x = np.frombuffer(ids, "<u4")
    small = not len(x) or int(x.max()) < 65536
    return (b"s" if small else b"l") + _zstd()[0](x.astype("<u2").tobytes() if small else ids)


def _unpack(data: bytes) -> bytes:
    raw = _zstd()[1](data[1:])
    return np.frombuffer(raw, "<u2").astype("<u4").tobytes() if data[:1] == b"s" else raw


def _encode_rows(vocab: str, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.binary()), ("ends", pa.binary()), ("ids", pa.binary())])

    def rows(batches):
        enc = encoder(vocab)
        for b in (x for x in batches if x.num_rows):
            found, ends = enc.flat(b["text"])
            ids, cols = np.insert(found, ends, end_id), ([], [], [])
            first = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
            # many documents at once; a mark whose window reaches back into another document doesn't count
            found = [marks(ids[first[lo] : first[min(lo + 256, b.num_rows)]]) + first[lo] for lo in range(0, b.num_rows, 256)]
            at = np.concatenate([np.zeros(0, np.int64), *found])
            doc = np.searchsorted(first, at, "left") - 1
            at, doc = (x[at - first[doc] >= WINDOW] for x in (at, doc))
            split = np.searchsorted(doc, np.arange(b.num_rows + 1)).tolist()
            at = (at - first[doc]).tolist()
            raw, bounds = memoryview(ids.astype("<u4", copy=False)).cast("B"), first.tolist()
            few = memoryview(ids.astype("<u2")).cast("B") if int(ids.max()) < 65536 else None
            for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
                ends = cuts(hi - lo, at[split[k] : split[k + 1]])
                cols[0].append(b"".join([digest(raw[4 * (lo + s) : 4 * (lo + e)]) for s, e in zip([0, *ends], ends)]))
                cols[1].append(struct.pack(f"<{len(ends)}q", *ends))
                cols[2].append(_pack(raw[4 * lo : 4 * hi]) if few is None else b"s" + _zstd()[0](few[2 * lo : 2 * hi]))
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), b["row"].cast(pa.int64()), pa.array(np.diff(first)), *(pa.array(c, pa.binary()) for c in cols)], schema=schema)

    return rows


_STORED = pa.schema(
    [("segment", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int64()), ("seg_start", pa.int64()), ("n_tokens", pa.int64()), ("recipe", pa.binary()), ("ends", pa.binary()), ("apart", pa.binary()), ("inline", pa.binary()), ("shared", pa.list_(pa.struct([("digest", pa.binary()), ("data", pa.binary())]))), ("root", pa.binary())]
)
_STORED_SQL = "segment int, doc_id long, row long, seg_start long, n_tokens long, recipe binary, ends binary, apart binary, inline binary, shared array<struct<digest:binary,data:binary>>, root binary"


def _store_rows(batches):
    """Rows come in order, a document's list of shared chunks before the document itself."""
    from pyspark import TaskContext

    segment, start, marks = TaskContext.get().partitionId(), 0, {}
    names = [f.name for f in _STORED]
    for b in batches:
        out = [[] for _ in names]
        cols = (b[c] for c in ("doc_id", "row", "n_tokens", "digests", "ends", "ids", "marks"))
        for doc, row, n, d, ends, ids, listed in zip(*(c.to_pylist() for c in cols)):
            if n is None:
                marks = {m["pos"]: m["owner"] for m in listed}
                continue
            chunks = len(d) // 16
            apart, shared = bytearray(chunks), []
            if marks:
                raw, inline, s = _unpack(ids), [], 0
                for i, e in enumerate(np.frombuffer(ends, "<i8").tolist()):
                    if i not in marks:
                        inline.append(raw[4 * s : 4 * e])
                    else:
                        apart[i] = 1
                        if marks[i]:
                            shared.append({"digest": d[16 * i : 16 * i + 16], "data": _pack(raw[4 * s : 4 * e])})
                    s = e
                ids = _pack(b"".join(inline))
            root = merkle([d[i : i + 16] for i in range(0, len(d), 16)])
            for to, x in zip(out, (segment, doc, row, start, n, d, ends, bytes(apart), ids, shared, root)):
                to.append(x)
            start, marks = start + n, {}
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _STORED)], schema=_STORED)


def _manifest_rows(batches):
    """One line for each segment, whose documents come in their order: -1 tokens if one doesn't start where the one before it ends."""
    lines: dict[int, list] = {}
    for b in batches:
        for segment, doc, start, n, root in zip(*(b[c].to_pylist() for c in ("segment", "doc_id", "seg_start", "n_tokens", "root"))):
            line = lines.setdefault(segment, [0, []])
            line[0] = line[0] + n if line[0] == start else -1
            line[1].append(digest(b"%d:" % doc + root if doc is not None else root))
    keys = sorted(lines)
    cols = [pa.array(keys, pa.int32()), pa.array([len(lines[k][1]) for k in keys], pa.int64()), pa.array([lines[k][0] for k in keys], pa.int64()), pa.array([merkle(lines[k][1]) for k in keys], pa.binary())]
    yield pa.RecordBatch.from_arrays(cols, names=["segment", "n_docs", "n_tokens", "root"])


def _manifest(stored: DataFrame) -> DataFrame:
    parts = stored.select("segment", "doc_id", "seg_start", "n_tokens", "root").repartition("segment").sortWithinPartitions("segment", "seg_start")
    return parts.mapInArrow(_manifest_rows, "segment int, n_docs long, n_tokens long, root binary")


def _top(lines: list) -> tuple:
    """Numbers of segments, documents and tokens, and the Merkle root, of manifest lines in their order."""
    return len(lines), sum(x["n_docs"] for x in lines), sum(x["n_tokens"] for x in lines), merkle([bytes(x["root"]) for x in lines])


def write_store(docs: DataFrame, path: str, vocab: str = "byte_bpe_50k.json", end_id: int = END_ID, scratch: Scratch | None = None) -> None:
    """Encode every text of docs (doc_id, text; null text: empty) and write the store to path.

    Rows are in ascending doc_id (null first), equal doc_ids in the order of reading; a row without words is
    the end id alone; an empty table gives an empty store.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "token-store")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    coded = scratch.keep(rows.mapInArrow(_encode_rows(vocab, end_id), "doc_id long, row long, n_tokens long, digests binary, ends binary, ids binary"), "coded")
    each = F.expr("transform(sequence(0, length(digests) div 16 - 1), i -> substring(digests, cast(16 * i + 1 as int), 16))")
    places = coded.select("row", "doc_id", F.posexplode(each).alias("pos", "digest"))
    place = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), "row", "pos")
    places = places.withColumn("at", place)
    owners = places.groupBy("digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    # kept, since dealing by range reads its input twice
    marks = places.join(owners, "digest").groupBy("row", "doc_id").agg(F.collect_list(F.struct("pos", (F.col("at") == F.col("first")).alias("owner"))).alias("marks"))
    marks = scratch.keep(marks, "marks")
    none = lambda t: F.lit(None).cast(t)
    lists = marks.select("doc_id", "row", F.lit(0).alias("kind"), "marks", none("long").alias("n_tokens"), *(none("binary").alias(c) for c in ("digests", "ends", "ids")))
    whole = coded.select("doc_id", "row", F.lit(1).alias("kind"), none("array<struct<pos:int,owner:boolean>>").alias("marks"), "n_tokens", "digests", "ends", "ids")
    both = lists.union(whole).repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row", "kind")
    both.mapInArrow(_store_rows, _STORED_SQL).write.mode("overwrite").option("compression", "none").parquet(f"{path}/documents")
    stored = spark.read.parquet(f"{path}/documents")
    # one line for each file: their number is that of the tasks, not of the rows
    lines = sorted(_manifest(stored).collect(), key=lambda x: x["segment"])
    base, rows = 0, []
    for x in lines:
        rows.append((*x, base))
        base += x["n_tokens"]
    spark.createDataFrame(rows, "segment int, n_docs long, n_tokens long, root binary, seg_base long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    spark.createDataFrame([_top(lines)], "n_segments long, n_docs long, n_tokens long, root binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/top")
    scratch.drop("coded")
    scratch.drop("marks")


def verify(spark, path: str) -> None:
    """Raises ValueError unless the store's documents are those of its manifest, and its lines those of the top line."""
    lines = sorted(spark.read.parquet(f"{path}/manifest").collect(), key=lambda x: x["segment"])
    top = [(x["n_segments"], x["n_docs"], x["n_tokens"], bytes(x["root"])) for x in spark.read.parquet(f"{path}/top").collect()]
    if top != [_top(lines)]:
        raise ValueError("the manifest doesn't match the top line")
    if [x["seg_base"] for x in lines] != [sum(x["n_tokens"] for x in lines[:k]) for k in range(len(lines))]:
        raise ValueError("the segments don't start where those before them end")
    found = {tuple(x) for x in _manifest(spark.read.parquet(f"{path}/documents")).collect()}
    wrong = {tuple(x)[:4] for x in lines} ^ found
    if wrong:
        raise ValueError(f"segments {sorted({x[0] for x in wrong})}: documents are missing, repeated, moved or changed")


def _read_rows(of=None):
    """Rebuild each document from its chunks and hold it against its recipe and root; ids, or what of makes of them."""
    kind = pa.int64() if of else pa.binary()
    schema = pa.schema([("doc_id", pa.int64()), ("segment", pa.int32()), ("seg_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", kind)])

    def rows(batches):
        for b in batches:
            out = []
            for doc, d, ends, apart, inline, root, lent in zip(*(b[c].to_pylist() for c in ("doc_id", "recipe", "ends", "apart", "inline", "root", "lent"))):
                ids, ends = _unpack(inline), np.frombuffer(ends, "<i8").tolist()
                if lent is not None:
                    lent, at, s, parts = {x["digest"]: x["data"] for x in lent}, 0, 0, []
                    for i, e in enumerate(ends):
                        if apart[i]:
                            if d[16 * i : 16 * i + 16] not in lent:
                                raise ValueError(f"document {doc}: chunk {i} is missing")
                            parts.append(_unpack(lent[d[16 * i : 16 * i + 16]]))
                        else:
                            parts.append(ids[at : at + 4 * (e - s)])
                            at += 4 * (e - s)
                        s = e
                    ids = b"".join(parts)
                if b"".join(digest(ids[4 * s : 4 * e]) for s, e in zip([0, *ends], ends)) != d or len(ids) != 4 * ends[-1]:
                    raise ValueError(f"document {doc}: a chunk doesn't match its digest")
                if merkle([d[i : i + 16] for i in range(0, len(d), 16)]) != root:
                    raise ValueError(f"document {doc}: its recipe doesn't match its root")
                out.append(of(ids) if of else ids)
            if out:
                yield pa.RecordBatch.from_arrays([*(b[c].cast(schema.field(c).type) for c in schema.names[:4]), pa.array(out, kind)], schema=schema)

    return rows


def _apart_rows(batches):
    schema = pa.schema([("row", pa.int64()), ("digest", pa.binary())])
    for b in batches:
        rows, found = [], []
        for r in b.to_pylist():
            own = {r["recipe"][16 * i : 16 * i + 16] for i, x in enumerate(r["apart"]) if x}
            rows += [r["row"]] * len(own)
            found += own
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, pa.binary())], schema=schema)


def read_store(spark, path: str, of: Callable[[bytes], int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, rebuilt and verified; ids: little-endian 32-bit, or the number that of makes of them.

    Raises ValueError if documents and manifest differ, at once, and if chunks do, when the rows are read.  An empty store gives
    no rows; a null doc_id comes back as null; extra columns of the documents aren't stored."""
    verify(spark, path)
    stored = spark.read.parquet(f"{path}/documents")
    lines = spark.read.parquet(f"{path}/manifest").select("segment", "seg_base")
    chunks = stored.select(F.explode("shared").alias("c")).select("c.digest", "c.data")
    lack = F.instr(F.hex("apart"), "01") > 0
    wanted = stored.where(lack).select("row", "recipe", "apart").mapInArrow(_apart_rows, "row long, digest binary")
    lent = wanted.join(chunks, "digest").groupBy("row").agg(F.collect_list(F.struct("digest", "data")).alias("lent"))
    cols = ["doc_id", "segment", "seg_start", "n_tokens", "recipe", "ends", "apart", "inline", "root"]
    # a document none of whose chunks is found keeps its place, so that its lack is noticed
    some = stored.where(lack).select("row", *cols).join(lent, "row", "left").select(*cols, F.coalesce("lent", F.array().cast(lent.schema["lent"].dataType)).alias("lent"))
    rest = stored.where(~lack).select(*cols, F.lit(None).cast("array<struct<digest:binary,data:binary>>").alias("lent"))
    docs = rest.union(some).mapInArrow(_read_rows(of), f"doc_id long, segment int, seg_start long, n_tokens long, ids {'long' if of else 'binary'}")
    return docs.join(F.broadcast(lines), "segment").select("doc_id", (F.col("seg_base") + F.col("seg_start")).alias("start"), "n_tokens", "ids")
