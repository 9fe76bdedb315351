"""Line dedup: a segment-partition edit join, in DataFrame functions only.

A line of at least near_chars code points is cut into edits + 1 segments; two lines within edits of one another share
one of them, shifted by few places.  From short_chars on a line may be one edit off (SHORT_EDITS) and is cut into two;
the shorter of two lines decides.  So each line puts its segments into an index by (length, segment number,
segment), and probes it for its own length and the shorter ones with the substrings that the multi-match bounds leave.

Lines that share a segment with more than HOT others are cut once more, into PIECES: within edits of one another, they
share all pieces but as many as there are edits, those before the first edit in place, those behind the last one moved
by the difference in length.  Each way to leave out pieces is a key; what is left out is again within so many edits, and
where more than HOT lines share a key it is cut in turn.  So lines meet only if they share ever more.  A hot key's lines are held
against the least of them at every cut; where all are in one class nothing is left to compare.

Candidates whose letter counts and pieces allow it are verified by a banded bit-parallel edit distance.  Equal lines
are one entry of the index.  Lines linked, directly or through others, form a class; all but its first occurrence, by
document and line, are dropped.  Of lines under short_chars all equal ones are dropped but the first; blank lines are let be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch

#: Lines this long may be SHORT_EDITS or edits apart: below, two different lines that near often say different things.
SHORT_CHARS, NEAR_CHARS = 20, 40
SHORT_EDITS, EDITS = 1, 2
#: Lines that share a key with more others are cut on, into so many pieces, so often at most; after that a key's lines
#: outside its largest class are compared with all of them.
HOT, PIECES, DEPTH = 16, 5, 6
#: Lines aren't cut on where those that share a key are fewer than this in the mean of all lines.
WIDE = 256
#: Digests, or documents that lose lines (ten lines each in the mean), are sent to all executors only if there are at most so many.
BROADCAST_IDS = 200_000


def segment_shapes(edits: int) -> list[tuple]:
    """(t, d, same, j, off): a line that is d longer than the indexed one, t edits being allowed, looks at segment j, shifted by
    off; same: neither differs, so that its own segment is meant."""
    spread = lambda t, d, j: range(max(1 - j, d - (t + 1 - j)), min(j - 1, d + (t + 1 - j)) + 1)
    # of lines of one length both look: the middle moved to the left in one has moved to the right in the other
    return [(t, d, d == off == 0, j, off) for t in range(edits + 1) for d in range(t + 1) for j in range(1, t + 2) for off in spread(t, d, j) if d or off >= 0]


def piece_shapes(edits: int) -> list[tuple]:
    """(t, d, same, i, j, s): pieces i and j (0-based; one and the same, or next to one another: all from i to j) are left out, between
    them the longer line is shifted by s, behind them by d."""
    out = []
    for t in range(edits + 1):
        runs = [(i, min(i + t, PIECES) - 1) for i in range(PIECES - t + 1)] if t else [(0, -1)]  # all edits in t pieces that follow one another
        out += [(t, d, d == 0, i, j, 0) for i, j in runs for d in range(t + 1)]
        if t == 2:
            apart = [(i, j) for i in range(PIECES) for j in range(i + 2, PIECES)]
            out += [(t, d, d == s == 0, i, j, s) for i, j in apart for d in range(t + 1) for s in range(-t, t + 1) if abs(s) + abs(d - s) <= t]
    return out


def _shaped(rows: DataFrame, shapes: list[tuple], names: str) -> DataFrame:
    """rows once for each shape of their t and d; m: the length of the indexed line."""
    values = ", ".join(str(x) for x in shapes)
    table = rows.sparkSession.sql(f"SELECT * FROM VALUES {values} AS shapes(t, d, same, {names})")
    cut = rows.join(F.broadcast(table), ["t", "d"])
    return cut.withColumns({"m": F.col("n") - F.col("d"), "own": F.col("own") & F.col("same")})


def segments(rows: DataFrame, edits: int) -> DataFrame:
    """(key, id, equal, own): the segments that each of rows (g, id, equal, own, rest, n, t, d) looks for; its own ones are the index."""
    cut = _shaped(rows.withColumn("plain", F.octet_length("rest") == F.col("n")), segment_shapes(edits), "j, off")
    cut = cut.withColumn("at", F.expr("cast((j - 1) * (m div (t + 1)) + greatest(0, (j - 1) - (t + 1 - m % (t + 1))) + 1 + off as int)"))
    cut = cut.withColumn("size", F.expr("cast(m div (t + 1) + if(j > t + 1 - m % (t + 1), 1, 0) as int)")).where("at >= 1 AND at + size <= n + 1")
    # bytes are found at once, code points only from the start; the hash is the same
    key = F.expr("if(plain, xxhash64(g, j, substring(cast(rest as binary), at, size)), xxhash64(g, j, substring(rest, at, size)))")
    return cut.select(key.alias("key"), "id", (F.col("equal") & (F.col("off") == 0)).alias("equal"), "own")


def pieces(rows: DataFrame, edits: int) -> DataFrame:
    """(key, id, equal, own, bag, rest, n, t, d) of rows (g, id, equal, own, bag, rest, n, t, d): all ways to leave pieces out, and what is left out."""
    cut = _shaped(rows, piece_shapes(edits), "i, j, s")
    places = {"a": "m * i div {p}", "b": "m * (i + 1) div {p} + s", "c": "m * j div {p} + s", "e": "m * (j + 1) div {p} + d"}  # 0-based ends of the parts
    cut = cut.withColumns({k: F.expr(f"cast({v.format(p=PIECES)} as int)") for k, v in places.items()})
    two = "j > i + 1"
    cut = cut.where(f"if({two}, a <= b AND b <= c AND c <= e, a <= e) AND e <= n")
    key = F.expr(f"xxhash64(g, i, j, substring(rest, 1, a), if({two}, substring(rest, b + 1, c - b), ''), substring(rest, e + 1))")
    left = F.expr(f"if({two}, concat(substring(rest, a + 1, b - a), '\n', substring(rest, c + 1, e - c)), substring(rest, a + 1, e - a))")
    cut = cut.select(key.alias("key"), "id", "equal", "own", "bag", left.alias("rest"), "t", "d")
    return cut.withColumn("n", F.length("rest"))


def seeds(lines: DataFrame, edits: int, short_chars: int, near_chars: int) -> DataFrame:
    """Rows for segments and pieces: each line (id, line, n) looks for lines of its length and shorter ones."""
    options = []
    for t, longer in ((edits, True), (min(SHORT_EDITS, edits), False)):
        for d in range(t + 1):
            m = f"(n - {d})"
            fit = f"{m} >= {max(short_chars, near_chars)}" if longer else f"{m} >= {short_chars} AND {m} < {near_chars}"
            options.append(f"if({fit}, named_struct('t', {t}, 'd', {d}), null)")
    rows = lines.select("id", "line", "n", F.explode(F.expr(f"array({', '.join(options)})")).alias("o")).where("o IS NOT NULL")
    same = F.col("o.d") == 0
    return rows.select(F.expr("xxhash64(o.t, n - o.d)").alias("g"), "id", same.alias("equal"), same.alias("own"), F.col("line").alias("rest"), "n", "o.t", "o.d")


def within_edits(a: str, b: str, edits: int = EDITS) -> Column:
    """Whether columns a and b are at most edits apart: a band of 2 * edits + 1 diagonals in one word, Hyyrö's recurrence."""
    w, k = 2 * edits + 1, edits
    full, top = (1 << w) - 1, 1 << (w - 1)
    long, short = f"if(length({a}) >= length({b}), {a}, {b})", f"if(length({a}) >= length({b}), {b}, {a})"
    hits = " + ".join(f"if(get(p, i + {d - k}) = get(t, i), {1 << d}, 0)" for d in range(w))
    # v: the vertical deltas and the distance along the band's lower edge; each let() binds one value
    step = (
        f"(v, i) -> aggregate(array({hits}), v, (v, x) -> "
        f"aggregate(array(((((x & v.vp) + v.vp) & {full}) ^ v.vp) | x | v.vn), v, (v, d0) -> "
        f"aggregate(array(v.vn | (~(d0 | v.vp) & {full})), v, (v, hp) -> "
        f"named_struct('vp', (d0 & v.vp) | (~(shiftright(d0, 1) | hp) & {full}), 'vn', shiftright(d0, 1) & hp, "
        f"'dist', v.dist + if(i < size(p) - {k}, if(d0 & {top} = 0, 1, 0), "
        f"if(hp & shiftright({top // 2}, i - greatest(size(p) - {k}, 0)) = 0, 0, 1) - if(d0 & v.vp & shiftright({top // 2}, i - greatest(size(p) - {k}, 0)) = 0, 0, 1))))))"
    )
    start = f"named_struct('vp', {((1 << (k + 1)) - 1) << (w - k - 1)}, 'vn', 0, 'dist', {k})"
    run = f"aggregate(sequence(0, size(t) - 1), {start}, {step}).dist"
    whole = f"element_at(transform(array(struct(split({long}, '') AS p, split({short}, '') AS t)), s -> {run.replace('size(p)', 'size(s.p)').replace('size(t)', 'size(s.t)').replace('get(p,', 'get(s.p,').replace('get(t,', 'get(s.t,')}), 1)"
    return F.expr(f"CASE WHEN abs(length({a}) - length({b})) > {k} THEN false WHEN length({short}) <= {k} THEN length({long}) <= {k} OR levenshtein({a}, {b}) <= {k} ELSE {whole} <= {k} END")


#: Letters by group: an edit takes one from a group and adds one to another at most.
BAGS = ("a", "e", "io", "u", "r", "t", "n", "s", "hx", "ld", "cmk", ", .", "bgw", "fpvy", "0123456789")


def bag(line: str) -> Column:
    """How many characters of each group a line has."""
    return F.array(*(F.length(line) - F.length(F.translate(F.col(line), g, "")) for g in BAGS))


def near_bags(a: str, b: str, edits: str) -> Column:
    """A condition that lines within edits meet: the groups' counts differ by 2 * edits at most in all."""
    return F.expr(" + ".join(f"abs({a}[{k}] - {b}[{k}])" for k in range(len(BAGS))) + f" <= 2 * ({edits})")


def near_pieces(a: str, b: str, edits: int) -> Column:
    """A condition that lines within edits meet: of 4 * edits pieces of a, all but edits stand in b, shifted by edits at most."""
    p, found = 4 * edits, []
    for i in range(p):
        lo, hi = f"(length({a}) * {i} div {p})", f"(length({a}) * {i + 1} div {p})"
        piece, window = f"substring({a}, cast({lo} + 1 as int), cast({hi} - {lo} as int))", f"substring({b}, cast(greatest({lo} + 1 - {edits}, 1) as int), cast({hi} - {lo} + {2 * edits} as int))"
        found.append(f"if(instr({window}, {piece}) > 0, 1, 0)")
    return F.expr(f"{' + '.join(found) if found else '0'} >= {p - edits}")


#: A condition that lines with a common key meet if they are near in the way that the key stands for: what they left out is.
NEAR_RESTS = "levenshtein(rest, rest2, t) >= 0"
#: What a line is known by.
DIGEST = "unhex(md5(line))"


def _lines(docs: DataFrame) -> DataFrame:
    """Occurrences of the lines that are not blank: document (d, rid), number, line."""
    each = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("doc_id", "text").alias("rid"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    blank = F.ltrim("line", F.lit(" \t\n\x0b\f\r")) == ""
    return each.where(~blank)


def _linked(pairs: DataFrame, lines: DataFrame, edits: int, near_chars: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of digests, of pairs of ids, whose lines are at most edits apart, SHORT_EDITS where one is under near_chars."""
    short = min(SHORT_EDITS, edits)
    pairs = scratch.keep(pairs.distinct(), f"{name}-pairs")
    n = pairs.count()
    ids = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{name}-ids", n)
    few = ids.count() <= BROADCAST_IDS
    texts = scratch.keep(lines.select("id", "digest", "line").join(F.broadcast(ids) if few else ids, "id"), f"{name}-texts")
    texts = texts.withColumn("bag", bag("line"))
    both = pairs.join(texts.toDF("a", "da", "la", "ba"), "a").join(texts.toDF("b", "db", "lb", "bb"), "b")
    both = both.withColumn("long", F.least(F.length("la"), F.length("lb")) >= near_chars)
    near = both.where(near_bags("ba", "bb", f"if(long, {edits}, {short})")).where(F.when(F.col("long"), near_pieces("la", "lb", edits)).otherwise(near_pieces("la", "lb", short)))
    near = scratch.keep(near.select("da", "db", "la", "lb", "long"), f"{name}-near", n)
    links = near.where(F.when(F.col("long"), within_edits("la", "lb", edits)).otherwise(within_edits("la", "lb", short)))
    links = scratch.keep(links.select(F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b")), name)
    for part in ("pairs", "ids", "texts", "near"):
        scratch.drop(f"{name}-{part}")
    return links


def _rest(held: DataFrame, lines: DataFrame, edits: int, near_chars: int, scratch: Scratch) -> DataFrame:
    """Links of each key's lines outside its largest class with all that share it, if what they left out is near."""
    held = held.groupBy("key", "id", "root", "t", "rest").agg(F.max("own").alias("own"), F.first("bag").alias("bag"))
    main = held.groupBy("key", "root").agg(F.count("*").alias("k")).groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("main"))
    odd = held.join(main, "key").where("root <> main").select("key", F.col("id").alias("other"), F.col("root").alias("r2"), F.col("own").alias("own2"), F.col("bag").alias("bag2"), F.col("rest").alias("rest2"))
    rest = held.join(odd, "key").where("root <> r2 AND (own OR own2)").where(near_bags("bag", "bag2", f"{edits}")).where(NEAR_RESTS)
    return _linked(rest.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")), lines, edits, near_chars, scratch, "links-rest")


def near_links(lines: DataFrame, edits: int, short_chars: int, near_chars: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) of digests that join all lines (id, digest, line, n) which are near, directly or through others."""
    if edits not in (0, 1, 2):
        raise ValueError("edits: 0, 1 or 2")
    a_b = (F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    apart = "id <> other AND (NOT equal OR id < other)"
    keyed, links = segments(seeds(lines, edits, short_chars, near_chars), edits), None
    for depth in range(DEPTH + 1):
        index = keyed.where("own").groupBy("key").agg(F.count("*").alias("k"), F.min("id").alias("least"))
        # a key's lines are all among those that look for it: a lone one meets them here, more than one are sorted out below
        met = index.hint("shuffle_hash").join(keyed, "key").where("k > 1 OR least <> id AND (NOT equal OR least < id)")
        met = scratch.keep(met, f"met-{depth}")
        some = met.where(f"k <= {HOT} AND k > 1")
        few = some.where("own").select("key", *(c for c in ("id", "bag", "rest") if c in met.columns))
        few = few.join(some.drop("own", "k", "least", "n", "d").withColumnsRenamed({"id": "other", "bag": "bag2", "rest": "rest2"}), "key").where(apart)
        if depth:
            few = few.where(near_bags("bag", "bag2", f"{edits}")).where(NEAR_RESTS).join(roots.toDF("id", "r1"), "id", "left").join(roots.toDF("other", "r2"), "other", "left").where("coalesce(r1, id) <> coalesce(r2, other)")
        star = met.where(f"(k = 1 OR k > {HOT}) AND id <> least").select("id", F.col("least").alias("other"))
        found = _linked(few.select(*a_b).union(star.select(*a_b)), lines, edits, near_chars, scratch, f"links-{depth}")
        links = found if links is None else links.union(found)
        hot = met.where(F.col("k") > HOT)
        if hot.isEmpty():
            break
        both = components(links, scratch, f"cc-{depth}").toDF("digest", "root")
        names = lines.select("digest", "id")
        roots = scratch.keep(both.join(names, "digest").join(names.toDF("root", "root_id"), "root").select("id", F.col("root_id").alias("root")), f"roots-{depth}")
        held = hot.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        mixed = held.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        held = scratch.keep(held.join(mixed, "key"), f"held-{depth}")
        scratch.drop(f"met-{depth}")
        if held.isEmpty():
            break
        per = held.groupBy("key").agg(F.count("*").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("pairs"), F.sum("k").alias("rows")).head()
        if depth == DEPTH or depth and per["pairs"] <= WIDE * per["rows"]:
            links = links.union(_rest(held, lines, edits, near_chars, scratch))
            break
        if depth == 0:
            again = lines.join(held.select("id").distinct(), "id")
            part = seeds(again, edits, short_chars, near_chars).join(again.select("id", bag("line").alias("bag")), "id")
        else:
            part = held.select(F.col("key").alias("g"), "id", "equal", "own", "bag", "rest", "n", "t", "d")
        keyed = scratch.keep(pieces(part, edits), f"keyed-{depth + 1}")
    return links


def line_classes(docs: DataFrame, edits: int = EDITS, short_chars: int = SHORT_CHARS, near_chars: int = NEAR_CHARS, scratch: Scratch | None = None) -> DataFrame:
    """(digest, id, root): every line content that occurs again, itself or nearly; its class is named by the digest root."""
    scratch = scratch or Scratch(docs.sparkSession, "line-dedup")
    # grouped by the lines themselves, in hash tables: a first place or line beside the digest would have them sorted twice
    lines = _lines(docs).groupBy("line").agg(F.count("*").alias("copies"))
    # ids serve to find candidates: should two lines share one, both are verified
    lines = scratch.keep(lines.withColumns({"digest": F.expr(DIGEST), "id": F.xxhash64("line"), "n": F.length("line")}), "lines")
    links = near_links(lines.where(F.col("n") >= short_chars), edits, short_chars, near_chars, scratch)
    roots = scratch.keep(components(links, scratch, "cc"), "roots").withColumnRenamed("id", "digest")
    alone = lines.where("copies > 1").join(roots, "digest", "left_anti").select("digest", "id", F.col("digest").alias("root"))
    return alone.union(lines.select("digest", "id").join(roots, "digest").select("digest", "id", "root"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, short_chars: int = SHORT_CHARS, near_chars: int = NEAR_CHARS, scratch: Scratch | None = None) -> DataFrame:
    """docs with the text rid of repeated lines, and columns n_lines, n_dropped (all columns of docs stay, but for
    older ones of these two names).

    docs needs doc_id and text.  A null text stays null with no lines; an empty text is one empty line.
    Repeated rows (equal doc_id and text) are one document and keep the same lines; a null doc_id comes
    before all others.  Documents themselves are never dropped here.  Lines of short_chars code points or more are
    linked if SHORT_EDITS apart, those of near_chars or more if edits (0, 1 or 2) apart; shorter ones only if equal.
    """
    scratch = scratch or Scratch(docs.sparkSession, "line-dedup")
    classes = scratch.keep(line_classes(docs, edits, short_chars, near_chars, scratch), "classes")
    scratch.drop("lines")
    few = classes.count() <= BROADCAST_IDS
    if few:  # digests of those lines only whose ids are found
        again = _lines(docs).withColumn("id", F.xxhash64("line")).join(F.broadcast(classes), "id").where(f"digest = {DIGEST}")
    else:
        again = _lines(docs).withColumn("digest", F.expr(DIGEST)).drop("line").join(classes, "digest")
    again = scratch.keep(again.select("d", "rid", "no", "root"), "again")
    first = again.groupBy("root").agg(F.min(F.struct("d", "rid", "no")).alias("first"))
    again = again.join(F.broadcast(first) if few else first, "root")
    same = F.col("d").eqNullSafe(F.col("first.d")) & (F.col("rid") == F.col("first.rid")) & (F.col("no") == F.col("first.no"))
    drops = scratch.keep(again.where(~same).groupBy("d", "rid").agg(F.collect_set("no").alias("__drops")), "drops")
    scratch.drop("again")
    size = drops.agg(F.count("*").alias("docs"), F.sum(F.size("__drops")).alias("lines")).head()
    few = size["docs"] <= BROADCAST_IDS and (size["lines"] or 0) <= 10 * BROADCAST_IDS
    keyed = docs.withColumn("__rid", F.xxhash64("doc_id", "text"))
    drops = drops.withColumnsRenamed({"d": "__d", "rid": "__r"})
    hit = keyed.join(F.broadcast(drops) if few else drops, (F.col("__rid") == F.col("__r")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__d")), "left")
    stay = lambda parts: F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "__drops"), lambda i: F.get(parts, i))
    # only texts that lose lines are split, each once: a list of one list binds it
    kept = F.array_join(F.get(F.transform(F.array(F.split("text", "\n")), stay), F.lit(0)), "\n")
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    n_dropped = F.when(F.col("__drops").isNull(), 0).otherwise(F.size("__drops"))
    out = hit.withColumns({"n_lines": F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long"), "n_dropped": n_dropped.cast("long"), "text": F.when(F.col("__drops").isNull(), F.col("text")).otherwise(kept)})
    return out.select(*(c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")), "n_lines", "n_dropped")
