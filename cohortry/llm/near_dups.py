"""MinHash near-duplicates: a chosen-path set similarity join.

Every document becomes its set of w-word shingles.  Equal sets form one class.  In each of several
independent trees a class walks down from the root: a node picks one of the minwise coordinates (now and then
two, so that a pair at the threshold is kept) by its own path, and its members part by the value there.  A node with few members is a leaf; leaves are
compared exhaustively, larger nodes branch on.  Members of a node that is still large at the last level agree
on all chosen coordinates.  There are as many trees as a pair at the threshold needs to meet, whatever the nodes'
sizes are, but for a chance of MISS.

Nodes compare sketches, one byte for each of SKETCH minwise coordinates: a pair at the threshold agrees on fewer
than least_agree() of them with a chance below UNLIKE.  Full sets move only for pairs whose sketches agree, and every
link is verified on them, in rounds, so that no group emits all its pairs:

0. before any tree, each class against the least of those that agree with it on a whole band of coordinates; verified links
   give components.  A node whose members are all in one of them holds no link that could change it and ends there; so does
   a large one with one component and few other classes, which meet all of it in round 2;
1. each class against a few: the nearest and the least of other components that a leaf has for it, and some that lead larger
   nodes; verified links give components;
2. in leaves, those that have any partner of another component there, and all members of large nodes that ended: those outside the main component against
   all others, block by block, where only verified links come out.

Nodes of different trees that overlap so much that all pairs of their members are fewer than the pairs of
the nodes are compared as one group.  A pair inside one component can't change a component, so leaving it out loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .words import blocks

COORDINATES, LEVELS, LEAF = 64, 10, 48
#: Members and shingles of a block of a large node, or so.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
#: From the first of these levels on, nodes of so many members end: near copies stay together on all levels, whereas comparing the
#: sketches of so many costs less than to follow them further.
SETTLED, ENOUGH = 3, 2048
#: Coordinates of a band: classes that agree on one are held against the least of them before any tree.
BAND = 8
#: Coordinates of a sketch, those of the paths among them.
SKETCH = 256
#: Greatest chance that a pair at the threshold meets in no leaf or last node, and what a node keeps of such a pair on average.
MISS, GROWTH = 0.0015, 1.0625
#: Chance that the sketches of a pair at the threshold agree too little to be looked at.
UNLIKE = 1e-6
#: A member of a large node is held against the one that leads its part of so many members or fewer.
PART = 1024
#: Deepest leaders that a class is held against in the first round.
LEADERS = 3
#: Ids are sent to all executors only if there are at most so many.
BROADCAST_IDS = 200_000
_rng = np.random.Generator(np.random.PCG64(7))
_COEF = _rng.integers(1, 2**31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def second_share(threshold: float) -> float:
    """Share of the nodes that pick a second coordinate."""
    return min(max(GROWTH / threshold - 1, 0), 1)


def missed(threshold: float, trees: int, levels: int = LEVELS) -> float:
    """Chance that a pair at the threshold meets in no tree at the last level, over all sketches that it may have."""
    two, total = second_share(threshold), 0.0
    for k in range(COORDINATES + 1):
        agree, lost = k / COORDINATES, 0.0
        for _ in range(levels):
            one = 1 - agree + agree * lost
            lost = (1 - two) * one + two * one * one
        total += comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k) * lost**trees
    return total


def trees_for(threshold: float) -> int:
    """Least number of trees in which a pair at the threshold meets but for a chance of MISS."""
    trees = 1
    while missed(threshold, trees) > MISS:
        trees += 1
    return trees


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, in order; A-Z are lower-cased."""
    for _, _, w in blocks(texts, lower=True):
        h, at = w.grams(width)
        first = np.searchsorted(at, w.first)
        for d in range(w.n):
            if w.count[d] >= width:
                yield np.unique(h[first[d] : first[d + 1]])
            else:
                yield np.array([w.whole(d)], np.uint64) if w.count[d] else np.zeros(0, np.uint64)


def least_agree(threshold: float) -> int:
    """Least agreement of two sketches that a pair at the threshold stays under with a chance of UNLIKE at most."""
    p, total, k = threshold + (1 - threshold) / 256, 0.0, 0
    while (total := total + comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)) <= UNLIKE:
        k += 1
    return k


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Minwise values of the path coordinates, and a byte of each of all, one row for each set; sets are not empty."""
    sig, low = np.zeros((len(sets), COORDINATES), np.uint32), np.zeros((len(sets), SKETCH), np.uint8)
    lo = 0
    while lo < len(sets):
        hi, total = lo, 0
        while hi < len(sets) and (hi == lo or total + len(sets[hi]) <= 100_000):
            total += len(sets[hi])
            hi += 1
        flat = np.concatenate(sets[lo:hi]).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[lo : hi - 1])])
        product = np.empty_like(flat)
        for t in range(SKETCH):
            least = np.minimum.reduceat(np.multiply(flat, _COEF[t], out=product), starts)
            low[lo:hi, t] = least & np.uint32(255)
            if t < COORDINATES:
                sig[lo:hi, t] = least
        lo = hi
    return sig, low


def _sketch_rows(width: int):
    import hashlib

    schema = pa.schema([("doc_id", pa.int64()), ("tkey", pa.binary()), ("n_shingles", pa.int64()), ("cid", pa.binary()), ("sig", pa.binary()), ("sketch", pa.binary())])

    def rows(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                sets = list(shingle_sets(part["text"], width))
                full = [s for s in sets if len(s)]
                two = [iter(x) for x in sketches(full)] if full else [iter(())] * 2
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"].cast(pa.int64()),
                        part["tkey"].cast(pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        *(pa.array([next(x).tobytes() if len(s) else None for s in sets], pa.binary()) for x in two),
                    ],
                    schema=schema,
                )

    return rows


def _set_rows(width: int):
    schema = pa.schema([("cid", pa.binary()), ("shingles", pa.binary())])

    def rows(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part["cid"].cast(pa.binary()), pa.array([s.tobytes() for s in shingle_sets(part["text"], width)], pa.binary())], schema=schema)

    return rows


_NEAR = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("agree", pa.int32())])


def _agree_rows(least: int):
    """Keeps candidate pairs whose sketches agree on at least so many coordinates."""

    def rows(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("sa", "sb"))
                agree = (x == y).sum(1)
                yield pa.RecordBatch.from_arrays([b["a"], b["b"], pa.array(agree, pa.int32())], schema=_NEAR).filter(pa.array(agree >= least))

    return rows


def _leaf_rows(num: int, den: int, least: int):
    """(path, cid, near, least, agree): the members of a leaf that have partners of another component there, by sizes and sketches, with
    their nearest and least one."""
    schema = pa.schema([("path", pa.int64()), ("cid", pa.binary()), ("near", pa.binary()), ("least", pa.binary()), ("agree", pa.int32())])

    def rows(batches):
        for batch in batches:
            out = []
            for path, x in zip(batch["path"].to_pylist(), batch["x"]):
                x = x.as_py()
                sketch, size, cids = np.frombuffer(b"".join(m["sketch"] for m in x), np.uint8).reshape(-1, SKETCH), np.array([m["n_shingles"] for m in x]), [m["cid"] for m in x]
                names = {r: k for k, r in enumerate({m["root"] for m in x})}
                root = np.array([names[m["root"]] for m in x])
                for i in range(len(x)):
                    agree = (sketch == sketch[i]).sum(1)
                    agree[(agree < least) | (den * np.minimum(size, size[i]) < num * np.maximum(size, size[i]))] = -1
                    agree[root == root[i]] = -1
                    fit = np.flatnonzero(agree >= 0)
                    if len(fit):
                        near = int(agree.argmax())
                        out.append((path, cids[i], cids[near], min(cids[j] for j in fit), int(agree[near])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 5, schema)], schema=schema)

    return rows


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    inter = int((large[at] == small).sum())
    return den * inter >= num * (len(x) + len(y) - inter)


def _block_rows(num: int, den: int, least: int):
    """Verified links between members of x outside the main component and members of y; found ones join components here too."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def rows(batches):
        for batch in batches:
            found = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = x.as_py(), y.as_py()
                names = {r: k for k, r in enumerate({m["root"] for m in (*x, *y)})}
                root = np.array([names[m["root"]] for m in y])
                mine = np.array([names[m["root"]] for m in x])
                size, sketch = np.array([m["n_shingles"] for m in y]), np.frombuffer(b"".join(m["sketch"] for m in y), np.uint8).reshape(-1, SKETCH)
                odd, sets = np.array([m["odd"] for m in y]), [np.frombuffer(m["shingles"], np.uint64) for m in y]
                cids = np.array([m["cid"].hex() for m in y])
                for i, m in enumerate(x):
                    own, n = np.frombuffer(m["shingles"], np.uint64), m["n_shingles"]
                    fit = (root != mine[i]) & (den * np.minimum(size, n) >= num * np.maximum(size, n)) & (~odd | (cids > m["cid"].hex()))
                    at = np.flatnonzero(fit)
                    at = at[(sketch[at] == np.frombuffer(m["sketch"], np.uint8)).sum(1) >= least]
                    for j in at.tolist():
                        if root[j] != mine[i] and linked(own, sets[j], num, den):
                            found.append(tuple(sorted((m["cid"], y[j]["cid"]))))
                            was, now = root[j], mine[i]
                            root[root == was], mine[mine == was] = now, now
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (zip(*found) if found else ((), ()))], schema=schema)

    return rows


def _verify_rows(num: int, den: int):
    """Keeps pairs with den * intersection >= num * union."""

    def rows(batches):
        for b in batches:
            keep = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), num, den) for x, y in zip(b["xa"], b["xb"])]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows


def _chosen(path, sig, two):
    """Coordinates that a node selects: one always, a second at a share of two of the nodes; with the value there."""
    at = lambda x: F.expr(f"substring(sig, cast(pmod({x}, {COORDINATES}) as int) * 4 + 1, 4)")
    first = F.struct(F.lit(0).alias("k"), at(f"xxhash64({path}, 1)").alias("v"))
    second = F.struct(F.lit(1).alias("k"), at(f"xxhash64({path}, 2)").alias("v"))
    return F.when(F.expr(f"pmod(xxhash64({path}, 3), 1000) < {round(1000 * two)}"), F.array(first, second)).otherwise(F.array(first))


def chosen_paths(classes: DataFrame, scratch: Scratch, threshold: float = 0.8, roots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, cid, n) of the leaves and of the larger nodes that end, n being their size, for classes (cid, sig) and
    the components (id, root) known of them; and leaders (cid, leader, level): for members of the larger nodes at every level that don't end
    one of them, in parts.  Nodes within one component are left out."""
    two = second_share(threshold)
    classes = classes.join(roots.withColumnRenamed("id", "cid"), "cid", "left") if roots else classes.withColumn("root", F.lit(None).cast("binary"))
    kept = ("cid", "sig", "root")
    rows = classes.select(*kept, F.explode(F.sequence(F.lit(1), F.lit(trees_for(threshold)))).alias("tree")).select(*kept, F.expr("xxhash64(tree, 77)").alias("path"))
    size = None
    for level in range(1, LEVELS + 1):
        rows = rows.select("cid", "root", "path", F.explode(_chosen("path", "sig", two)).alias("c")).select("cid", "root", F.expr(f"xxhash64(path, c.k, c.v, {level})").alias("path"))
        per = rows.groupBy("path").agg(F.count("*").alias("n"), F.expr("count(*) - count(root)").alias("alone"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        mixed = per.where("n > 1 AND (alone > 0 OR lo <> hi)")
        ends = F.expr(f"n <= {ENOUGH if level >= SETTLED else LEAF} OR alone <= {LEAF} AND lo = hi") if level < LEVELS else F.lit(True)
        mixed = mixed.select("path", "n", F.coalesce(ends, F.lit(False)).alias("ends"))
        rows = scratch.keep(rows.join(mixed, "path").select("path", "cid", "n", "ends", F.lit(level).alias("level")), f"level-{level}", size)
        large = rows.where("NOT ends")
        size = large.count()
        if level == LEVELS or not size:
            break
        rows = large.select("cid", "path").join(classes.select(*kept), "cid")
    every = scratch.spark.read.schema(large.schema).parquet(*(scratch.path(f"level-{k}") for k in range(1, level + 1)))
    parts = every.where(f"NOT ends OR level = {LEVELS} AND n > {LEAF}").select("path", F.expr(f"pmod(xxhash64(path, cid), ceil(n / {PART}))").alias("part"), "cid", "level")
    lead = parts.groupBy("path", "part").agg(F.min_by("cid", F.xxhash64("cid", "path")).alias("leader"))
    leaders = parts.join(lead, ["path", "part"]).where("cid <> leader").select("cid", "leader", "level")
    return every.where("ends").select("path", "cid", "n"), leaders


def _sets(ids: DataFrame, classes: DataFrame, texts: DataFrame, width: int, scratch: Scratch, name: str, rows: int | None = None) -> DataFrame:
    """(cid, shingles) of the classes named in ids (cid, no row twice; rows: about as many)."""
    ids = scratch.keep(ids.join(classes.select("cid", "tkey"), "cid"), f"{name}-ids", rows)
    n = ids.count()
    if n <= BROADCAST_IDS:
        texts, ids = texts.join(F.broadcast(ids), "tkey").groupBy("cid").agg(F.first("text").alias("text")), None
    else:  # copies of a text are one row before any of them meet
        texts = texts.groupBy("tkey").agg(F.first("text").alias("text")).join(ids, "tkey")
    return scratch.keep(texts.mapInArrow(_set_rows(width), "cid binary, shingles binary"), f"{name}-sets", n)


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of class ids, no pair twice, that reach the threshold on full sets, as a table of that name."""
    pairs = scratch.keep(pairs.select("a", "b"), f"{name}-pairs")
    n = pairs.count()
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), classes, texts, width, scratch, name, n)
    both = pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
    both = both.select("a", "b", "xa", "xb").coalesce(scratch.parts(n))
    links = scratch.keep(both.mapInArrow(_verify_rows(num, den), "a binary, b binary"), name)
    for part in ("pairs", "ids", "sets"):
        scratch.drop(f"{name}-{part}")
    return links


def _alike(pairs: DataFrame, classes: DataFrame, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of class ids, with agree, that sizes and sketches allow, as a table of that name."""
    pairs = scratch.keep(pairs, f"{name}-pairs")
    n = pairs.count()
    of = lambda c, s: classes.select(F.col("cid").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(s))
    sized = pairs.join(of("a", "sa"), "a").join(of("b", "sb"), "b").where(F.expr(f"{den} * least(na, nb) >= {num} * greatest(na, nb)"))
    sized = sized.select("a", "b", "sa", "sb").coalesce(scratch.parts(n))
    found = scratch.keep(sized.mapInArrow(_agree_rows(least_agree(num / den)), "a binary, b binary, agree int"), name)
    scratch.drop(f"{name}-pairs")
    return found


def _by_bands(classes: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b): for each class the nearest and the least of the classes that are the least in one of its bands."""
    band = F.expr(f"xxhash64(k, substring(sig, k * {4 * BAND} + 1, {4 * BAND}))")
    bands = classes.select("cid", "sig", F.explode(F.sequence(F.lit(0), F.lit(COORDINATES // BAND - 1))).alias("k")).select("cid", band.alias("band"))
    lead = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("cid").alias("leader")).where("n > 1").drop("n")
    pairs = bands.join(lead, "band").where("cid <> leader").groupBy(F.col("cid").alias("a")).agg(F.collect_set("leader").alias("l"))
    alike = _alike(pairs.select("a", F.explode("l").alias("b")), classes, num, den, scratch, "bands")
    few = alike.groupBy("a").agg(F.max_by("b", F.struct("agree", "b")).alias("x"), F.min("b").alias("y"))
    few = few.select("a", F.explode(F.array_distinct(F.array("x", "y"))).alias("b"))
    return few.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _few_each(near: DataFrame, lead: DataFrame) -> DataFrame:
    """Pairs (a, b): for each class its nearest partner, its least one, and those that lead it."""
    few = near.groupBy("cid").agg(F.max_by("near", F.struct("agree", "near")).alias("x"), F.min("least").alias("y"))
    few = few.select("cid", "x").union(few.select("cid", "y")).toDF("cid", "other")
    return few.select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).union(lead.select("a", "b")).distinct()


def _groups(nodes: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, cid, root) of the nodes (path, cid) that hold several components: by node, or by all nodes that hang together."""
    held = nodes.join(roots.withColumnRenamed("id", "cid"), "cid", "left").select("path", "cid", F.coalesce("root", "cid").alias("root"))
    mixed = held.groupBy("path").agg(F.count("*").alias("n"), F.min("cid").alias("head"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    held = scratch.keep(held.join(mixed.select("path", "n", "head"), "path"), "held")
    whole = scratch.keep(components(held.select(F.col("cid").alias("a"), F.col("head").alias("b")), scratch, "cc-nodes"), "clusters").toDF("cid", "cluster")
    held = held.join(whole, "cid")
    nodes_cost = held.groupBy("cluster").agg(F.sum("n").alias("by_node"))  # each member meets all of its node
    cost = whole.groupBy("cluster").agg(F.count("*").alias("m")).join(nodes_cost, "cluster")
    held = held.join(cost.select("cluster", (F.col("m") * F.col("m") <= F.col("by_node")).alias("one")), "cluster")
    return scratch.keep(held.select(F.expr("if(one, xxhash64(cluster), path)").alias("g"), "cid", "root").distinct(), "groups")


def _large(groups: DataFrame, classes: DataFrame, texts: DataFrame, width: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Verified links of the groups' members that are outside the main component of a group."""
    sets = _sets(groups.select("cid").distinct(), classes, texts, width, scratch, "large")
    sized = groups.join(classes.select("cid", "n_shingles"), "cid")
    per = sized.groupBy("g", "root").agg(F.count("*").alias("k"), F.sum("n_shingles").alias("s"))
    per = per.groupBy("g").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.expr(f"cast(greatest(ceil(sum(k) / {BLOCK}), ceil(sum(s) / {BLOCK_SHINGLES})) as int)").alias("parts"))
    held = groups.join(per, "g").select("g", "cid", "root", "parts", (F.col("root") != F.col("main")).alias("odd"), F.expr("cast(pmod(xxhash64(cid), parts) as int)").alias("block"))
    full = held.join(classes.select("cid", "n_shingles", "sketch"), "cid").join(sets, "cid")
    member = F.struct("cid", "root", "odd", "n_shingles", "sketch", "shingles")
    every = full.groupBy("g", "block").agg(F.collect_list(member).alias("y"))
    odds = full.where("odd").groupBy("g", F.col("block").alias("own")).agg(F.collect_list(member).alias("x"), F.first("parts").alias("parts"))
    odds = odds.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return odds.join(every, ["g", "block"]).select("x", "y").mapInArrow(_block_rows(num, den, least_agree(num / den)), "a binary, b binary")


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    docs needs doc_id and text; other columns are not looked at.  Sets link if den * intersection >= num *
    union.  A null, empty or wordless text has an empty set and links with nothing; a text of fewer than width
    words is one shingle.  Equal texts share a component; component_id is the least doc_id of it (nulls are
    passed over, and a row without doc_id is never kept).  Repeated rows come out as often as they go in; an
    empty table gives an empty one.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near-dups")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr("unhex(md5(text))").alias("tkey"), "text")
    seen = scratch.keep(texts.mapInArrow(_sketch_rows(width), "doc_id long, tkey binary, n_shingles long, cid binary, sig binary, sketch binary"), "sketches")
    classes = scratch.keep(
        seen.where("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("least_id"), *(F.min(c).alias(c) for c in ("tkey", "n_shingles", "sig", "sketch"))), "classes"
    )
    seen = scratch.keep(seen.select("doc_id", "n_shingles", "cid"), "seen")
    scratch.drop("sketches")
    threshold, args = num / den, (classes, texts.select("tkey", "text"), width, num, den, scratch)
    links = _verified(_by_bands(classes, num, den, scratch), *args, "links0")
    roots = scratch.keep(components(links, scratch, "cc0"), "roots0")
    member = classes.join(roots.withColumnRenamed("id", "cid"), "cid", "left")
    nodes, leaders = chosen_paths(classes.select("cid", "sig"), scratch, threshold, roots)
    deepest = leaders.groupBy("cid").agg(F.expr(f"slice(reverse(array_sort(collect_set(struct(level, leader)))), 1, {LEADERS})").alias("l"))
    lead = _alike(deepest.select(F.col("cid").alias("a"), F.explode("l.leader").alias("b")), classes, num, den, scratch, "lead")
    lead = lead.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    leaf = nodes.where(F.col("n") <= LEAF).join(member.select("cid", "n_shingles", "sketch", F.coalesce("root", "cid").alias("root")), "cid")
    leaf = leaf.groupBy("path").agg(F.collect_list(F.struct("cid", "n_shingles", "sketch", "root")).alias("x"))
    near = leaf.mapInArrow(_leaf_rows(num, den, least_agree(threshold)), "path long, cid binary, near binary, least binary, agree int")
    near = scratch.keep(near, "near")
    first = _verified(_few_each(near, lead), *args, "first")
    # components found before go on as the links of their members with their roots
    joined = lambda roots, links: roots.toDF("a", "b").union(links.select("a", "b"))
    roots = scratch.keep(components(joined(roots, first), scratch, "cc1"), "roots1")
    groups = _groups(near.select("path", "cid").union(nodes.where(F.col("n") > LEAF).select("path", "cid")), roots, scratch)
    for name in (*(f"level-{k}" for k in range(1, LEVELS + 1)), "bands", "near", "lead", "held", "clusters"):
        scratch.drop(name)
    second = scratch.keep(_large(groups, *args), "second")
    scratch.drop("large-sets")
    if not second.isEmpty():
        roots = scratch.keep(components(joined(roots, second), scratch, "cc2"), "roots2")
    named = classes.select("cid", "least_id").join(roots.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "root").select("cid", "component_id")
    out = seen.join(named, "cid", "left")
    comp = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without all but one document of each component (the one with the least doc_id); columns unchanged.

    Repeated rows with one doc_id and text count as copies too: of them the least one (as JSON) stays.
    Rows without doc_id have nothing to be told apart by and stay, as do texts without words.
    """
    found = near_duplicates(docs, **options)
    lost = found.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    left = docs.join(lost, "doc_id", "left_anti").select(docs.columns)
    known = left.where("doc_id IS NOT NULL")
    twice = known.groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1").select("doc_id")
    once = known.join(twice, "doc_id", "left_anti").select(docs.columns)
    row = F.struct(*docs.columns)
    again = known.join(twice, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(row)).alias("__row")).select("__row.*")
    return once.unionByName(again).unionByName(left.where("doc_id IS NULL"))
