"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortry.llm import chat, decontaminate, line_dedup, near_dups, packing, quality_model, quality_rules, token_counts, token_store, tokens, url_filter
from cohortry.llm import components as cc
from cohortry.llm.scratch import Scratch
from cohortry.llm.tokens import Encoder
from cohortry.llm.words import blocks

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(3)


def prose(n, seed=None):
    r = random.Random(seed) if seed is not None else rng
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that tend to break things."""
    long = prose(30_000, 1)
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "word"), (4, "word"), (None, "nobody knows this one at all"), (None, None), (5, long), (6, long), (7, "a  b\n\n c\u00a0 d <|endoftext|> é \x1c"), (8, "one two"), (9, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("cid", "path", "row", "digest", "n", "d", "rid", "no", "line", "n_lines", "part", "size", "rank", "quality", "trusted", "held_out", "score"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def none_of(spark, df):
    return spark.createDataFrame([], df.schema)


def encoder():
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


# near-duplicates

def components_of(docs, width, num, den):
    sets = {}
    for i, t in docs:
        ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(ws[j : j + width]) for j in range(len(ws) - width + 1)} if len(ws) >= width else ({tuple(ws)} if ws else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            inter = len(sets[i] & sets[j])
            if inter and den * inter >= num * (len(sets[i]) + len(sets[j]) - inter):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    docs, base = [], prose(120, 5)
    for i in range(160):  # a large group of near copies: each a few words from the base
        ws = base.split()
        for _ in range(rng.randint(0, 4)):
            ws[rng.randrange(len(ws))] = prose(1)
        docs.append((i, " ".join(ws)))
    for i in range(160, 200):
        docs.append((i, prose(rng.randint(1, 60))))
    docs += [(200 + i, docs[160 + i][1]) for i in range(10)]
    got = near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=3, num=85, den=100).collect()
    want = components_of(docs, 3, 85, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_odd_rows(spark, odd):
    got = sorted((tuple(r) for r in near_dups.near_duplicates(odd, width=3, num=85, den=100).collect()), key=repr)
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r[0]].append(r)
    assert by[1] == [(1, 0, 1, True)] and by[2] == [(2, 0, 2, True)] and by[4] == [(4, 1, 4, True)] * 2
    assert by[6][0][2:] == (5, False) and by[9][0][2:] == (8, False)
    assert sorted(r[3] for r in by[None]) == [False, False]
    assert near_dups.near_duplicates(none_of(spark, odd)).count() == 0
    left = near_dups.keep_one(odd)
    assert left.columns == odd.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 0, 1, 2, 3, 4, 5, 7, 8]


def test_pairs_at_the_threshold_meet_in_large_nodes(spark):
    """A group whose pairs all have a similarity of 0.85 or so, far larger than a leaf at every level."""
    n, r = 1200, np.random.default_rng(5)
    sig = np.tile(r.integers(0, 2**32, near_dups.COORDINATES, dtype=np.uint32), (n, 1))
    own = r.random(sig.shape) > 0.85**0.5
    sig[own] = r.integers(0, 2**32, own.sum(), dtype=np.uint32)
    classes = spark.createDataFrame([(int(k).to_bytes(2, "big"), bytearray(x.tobytes())) for k, x in enumerate(sig)], "cid binary, sig binary")
    nodes, _ = near_dups.chosen_paths(classes, Scratch(spark, "test-paths"), 0.85)
    by, met = defaultdict(list), np.eye(n, dtype=bool)
    for x in nodes.select("path", "cid").collect():
        by[x["path"]].append(int.from_bytes(x["cid"], "big"))
    for at in by.values():
        met[np.ix_(at, at)] = True
    assert (~met).sum() <= 0.003 * n * (n - 1)


def test_nodes_within_one_component_end(spark, monkeypatch):
    """Copies known to hang together leave the trees at once, but where others share their nodes: those meet all of them."""
    monkeypatch.setattr(near_dups, "SETTLED", near_dups.LEVELS)
    r, name = np.random.default_rng(6), lambda k: int(k).to_bytes(2, "big")
    sig = np.tile(r.integers(0, 2**32, near_dups.COORDINATES, dtype=np.uint32), (400, 1))
    other = sig[0].copy()
    other[:6] += 1
    classes = lambda rows: spark.createDataFrame([(name(k), bytearray(x.tobytes())) for k, x in enumerate(rows)], "cid binary, sig binary")
    roots = spark.createDataFrame([(name(k), name(0)) for k in range(400)], "id binary, root binary")
    nodes, leaders = near_dups.chosen_paths(classes(sig), Scratch(spark, "test-one"), 0.85, roots)
    assert nodes.count() == 0 and leaders.count() == 0
    nodes, leaders = near_dups.chosen_paths(classes([*sig, other]), Scratch(spark, "test-two"), 0.85, roots)
    at = nodes.groupBy("path").agg(F.collect_set("cid").alias("cids")).collect()
    assert leaders.count() == 0 and at and all(len(x["cids"]) == 401 for x in at)


@pytest.mark.parametrize("few", [True, False])
def test_components_of_few_links_are_one_partition(spark, monkeypatch, few):
    """Steps over few links write one file; either way a component's root is its least id."""
    monkeypatch.setattr(cc, "ONE_PART", 1000 if few else 0)
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    r = random.Random(4)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(220)]
    scratch = Scratch(spark, "test-components")
    got = {x["id"]: x["root"] for x in cc.components(spark.createDataFrame(links, "a long, b long"), scratch, "cc").collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    want = {x: x for a, b in links if a != b for x in (a, b)}
    while (now := {x: min(want[y] for a, b in [(x, x), *links] if x in (a, b) for y in (a, b)) for x in want}) != want:
        want = now
    assert got == want
    files = spark.read.parquet(scratch.path("cc-1")).inputFiles()
    assert len(files) == 1 if few else len(files) > 1


@pytest.mark.parametrize("settled", [1, near_dups.LEVELS])
def test_near_duplicates_across_components_equal_brute_force(spark, monkeypatch, settled):
    """Groups of near copies, most of them just under the threshold to others of their group, some linked through a few."""
    for name, value in (("LEAF", 4), ("SETTLED", settled), ("ENOUGH", 30), ("BLOCK", 16)):
        monkeypatch.setattr(near_dups, name, value)
    docs, r = [], random.Random(11)
    for base in (prose(100, 21), prose(90, 22), prose(110, 23)):
        for _ in range(70):
            ws = base.split()
            for _ in range(r.choice((0, 1, 2, 3, 3, 4, 4))):
                ws[r.randrange(len(ws))] = f"w{r.randrange(10**6)}"
            docs.append((len(docs), " ".join(ws)))
    got = near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=3, num=85, den=100).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == components_of(docs, 3, 85, 100)


# tokens

def test_encoder_equals_the_library():
    ref, enc = encoder(), Encoder("byte_bpe_50k.json")
    parts = ["a", " ", "  ", "\n", "\t", "'s", "12", "!?", "é", "\u00a0", "\x1c", "<|endoftext|>", "Word", "…", "\r\n", "日本"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [None, "", prose(2000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [ref(t) for t in texts]


def test_new_pieces_reach_the_library_in_short_texts(monkeypatch):
    """Ids of more words than one short text holds, plain ASCII or not, are those of the library; no text has more of them."""
    words = [f"{prose(1)}{tail}" for k in range(5 * tokens.SHORT) for tail in ("", "é", "ß" if k % 7 else ".")]
    enc, seen = Encoder("byte_bpe_50k.json"), []
    many = enc.many
    monkeypatch.setattr(enc, "many", lambda texts: seen.extend(texts) or many(texts))
    text = " ".join(words)
    assert enc.encode([text]) == [np.array(many([text])[0], "<u4").tobytes()]
    assert max(len(t.split()) for t in seen) == tokens.SHORT


def test_words_lines_and_marks_are_encoded_apart():
    """Pieces across line ends and marks never reach the memory as they are, and the ids are those of the library."""
    ref, enc = encoder(), Encoder("byte_bpe_50k.json")
    text = "tish.\nNdatwh, eronsh tish\ntish!"
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode([text])] == [ref(text)]
    assert set(enc.spaced) == {"eronsh", "tish"} and set(enc.known) >= {"tish", "Ndatwh", "\n", ".", ",", "!"}
    parts, ends = ["tish", "Être", "日本", "a1", "don't", "x_y", "...", "<|endoftext|>", ".net", "²"], [" ", " ", "\n", ".\n", "!? ", ",", "_"]
    texts = ["".join(rng.choice(parts) + rng.choice(ends) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    more = [rng.choice(["", " ", "\n", " ", "\n\n"]) + t + rng.choice(["", " ", "\n", "\n\n", "\t"]) for t in texts]
    for some in (texts, more, [t for t in more if "\n" not in t.strip()] + [None, "", "\n", "\n\n", " \n", "\n "]):
        ids, at = enc.flat(some)
        assert [x.tolist() for x in np.split(ids, at)[:-1]] == [ref(t) for t in some]
    assert [len(x) for x in enc.flat([])] == [0, 0]


def test_token_store_round_trip(spark, odd):
    shared = prose(400, 8)
    more = spark.createDataFrame([(100 + i, prose(50, i) + " " + shared + " " + prose(50, i + 50)) for i in range(6)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(more)
    scratch = Scratch(spark, "test")
    token_store.write_store(docs.withColumns({"segment": F.lit("clash"), "recipe": F.lit(None)}), scratch.path("store"), scratch=scratch)
    got = sorted(token_store.read_store(spark, scratch.path("store")).collect(), key=lambda r: r["start"])
    ref, at = encoder(), 0
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    want = defaultdict(list)
    for r in rows:
        want[r["doc_id"]].append(np.array([*ref(r["text"]), 2], "<u4").tobytes())
    for r in got:
        assert r["start"] == at and r["ids"] in want[r["doc_id"]]
        want[r["doc_id"]].remove(r["ids"])
        at += r["n_tokens"]
    assert not any(want.values())
    stored = spark.read.parquet(scratch.path("store") + "/documents")
    digests = [x["digest"] for r in stored.select("shared").collect() for x in r["shared"]]
    assert digests and len(digests) == len(set(digests))  # each shared chunk once
    token_store.write_store(none_of(spark, docs), scratch.path("empty"))
    assert token_store.read_store(spark, scratch.path("empty")).count() == 0


def test_token_store_notices_damage():
    raw = np.arange(10, dtype="<u4").tobytes()
    row = {"doc_id": 1, "segment": 0, "seg_start": 0, "n_tokens": 10, "recipe": token_store.digest(b"other"), "ends": np.array([10], "<i8").tobytes(), "apart": b"\0", "inline": token_store._pack(raw), "root": b"", "lent": None}
    with pytest.raises(ValueError, match="digest"):
        list(token_store._read_rows()([pa.RecordBatch.from_pylist([row])]))


def test_token_store_notices_lost_moved_and_repeated_documents(spark, odd):
    scratch = Scratch(spark, "test")
    token_store.write_store(odd.select("text", "n", "doc_id"), scratch.path("store"), scratch=scratch)
    parts = {p: spark.read.parquet(scratch.path(f"store/{p}")) for p in ("documents", "manifest", "top")}
    docs = parts["documents"]
    one, two = F.col("doc_id") == 5, F.col("doc_id") == 7
    swapped = F.when(one, 7).when(two, 5).otherwise(F.col("doc_id")).cast("long")
    bad = {
        "lost": {"documents": docs.where(~one | F.col("doc_id").isNull())},
        "repeated": {"documents": docs.union(docs.where(one))},
        "swapped": {"documents": docs.withColumn("doc_id", swapped)},
        "segment": {"manifest": parts["manifest"].orderBy("segment").limit(parts["manifest"].count() - 1)},
        "nothing": {"documents": docs.limit(0)},
    }
    for name, change in bad.items():
        for p, df in (parts | change).items():
            df.write.mode("overwrite").parquet(scratch.path(f"{name}/{p}"))
        with pytest.raises(ValueError):
            token_store.read_store(spark, scratch.path(name))
    lost = docs.withColumn("shared", F.array().cast(docs.schema["shared"].dataType))
    for p, df in (parts | {"documents": lost}).items():
        df.write.mode("overwrite").parquet(scratch.path(f"chunks/{p}"))
    with pytest.raises(Exception, match="is missing"):
        token_store.read_store(spark, scratch.path("chunks")).collect()


def test_cutting_stock_meets_demand():
    for seed in range(8):
        r = np.random.default_rng(seed)
        demand = {int(s): int(n) for s, n in zip(r.choice(np.arange(1, 101), 12, replace=False), r.integers(1, 500, 12))}
        total, used = defaultdict(int), 0
        for pattern, copies in packing.cutting_stock(demand, 100):
            assert sum(s * k for s, k in pattern.items()) <= 100
            used += copies
            for s, k in pattern.items():
                total[s] += k * copies
        assert total == demand
        assert used <= 1.15 * max(sum(s * n for s, n in demand.items()) / 100, sum(n for s, n in demand.items() if s > 50)) + 60


def test_packing_places_every_id_once(spark, odd):
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1000, "text").limit(150))
    got = packing.pack(docs).toPandas()
    ref = encoder()
    want = sorted(len(ref(r["text"])) + 1 for r in docs.collect())
    assert got.length.sum() == sum(want)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024
    one = {r["doc_id"]: np.array([*ref(r["text"]), 0], "<u4") for r in docs.collect() if r["doc_id"] and r["doc_id"] > 1000}
    for r in got[got.doc_id > 1000].itertuples():
        assert r.ids_crc32 == zlib.crc32(one[r.doc_id][r.start : r.start + r.length].tobytes())
    assert packing.pack(none_of(spark, docs)).count() == 0


def test_packing_encodes_a_batch_at_once(monkeypatch):
    """All texts of a batch go to the encoder in one call, and its pieces hold the library's ids with the end id."""
    import pyspark

    calls, flat = [], Encoder.flat
    monkeypatch.setattr(Encoder, "flat", lambda self, texts: calls.append(len(texts)) or flat(self, texts))
    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 3})()))
    texts = [*(prose(5, k) for k in range(600)), None, "", prose(3000)]
    batch = pa.record_batch({"doc_id": [*range(len(texts))], "row": [*range(len(texts))], "text": texts})
    got = [r for b in packing._piece_rows("byte_bpe_50k.json", 0, 1024)([batch.slice(0, 0), batch]) for r in b.to_pylist()]
    assert calls == [len(texts)]
    ref, want = encoder(), []
    for k, t in enumerate(texts):
        ids = np.array([*ref(t), 0], "<u4")
        want += [(k, s, len(ids[s : s + 1024]), zlib.crc32(ids[s : s + 1024].tobytes()), len(ids)) for s in range(0, len(ids), 1024)]
    assert [(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got] == want


def test_token_counts_and_cache(spark, odd):
    cache = Scratch(spark, "cache").path("counts")
    ref = encoder()
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(ref(r["text"]))) for r in odd.collect()), key=repr)
    for _ in range(2):
        got = token_counts.token_counts(odd, cache=cache).collect()
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=repr) == want
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("digest").distinct().count() == len({r["text"] or "" for r in odd.collect()})
    assert token_counts.token_counts(none_of(spark, odd)).count() == 0


# chats

def test_chat_round_trip(spark):
    texts = [r"\### Assistant: </turn> ok", "<turn:user>", "a\\lb\\", "", "é日本 <|endoftext|>", "!bang", " lead", "tail \n", None]
    rows = [(c, t, "assistant" if t % 2 else "user", texts[(c + t) % len(texts)]) for c in range(9) for t in range(5)]
    rows += [(50, t, rng.choice(["assistant", "user"]), prose(300, t)) for t in range(500)]  # longer than a part
    rows += [(60, None, "assistant", "x"), (60, 1, None, "y"), (60, 1, "a:<b>", "y"), (None, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ord", F.lit(1))
    path = Scratch(spark, "chats").path("out")
    chat.format_chats(df, path)
    assert spark.read.parquet(path).where("conv_id = 50").count() > 1
    got = {r["conv_id"]: r for r in chat.chat_digests(spark, path).collect()}
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    key = lambda x: (x is not None, x or (0 if not isinstance(x, str) else ""))
    for c, g in groups.items():
        g.sort(key=lambda r: (key(r[1]), key(r[2]), key(r[3])))
        h, loss = hashlib.sha256(), ""
        for _, _, role, text in g:
            h.update(f"{role or ''}\n{text or ''}\n".encode())
            loss += (text or "") if role == "assistant" else ""
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(g), h.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_parts_of_a_chat_are_its_own_choice(spark):
    rows = [(c, t, "user", "ab") for c in range(40) for t in range(6)] + [(70, t, "assistant", "x y") for t in range(-3, 600)]
    df, before, seen = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        path = Scratch(spark, "chats").path("out")
        chat.format_chats(df.repartition(int(n)), path)
        seen.append(sorted(map(tuple, spark.read.parquet(path).select("conv_id", "block", "ord", "rendered").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]
    assert [r[1] for r in seen[0] if r[0] == 70] == [-1, 0, 1, 2] and len(seen[0]) == 40 + 4


def test_chat_odd_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, rendered string, ids int, spans int")
    some = spark.createDataFrame([(1, 0, "assistant", "x", "a", 1, 2)], empty.schema)
    for df, n in ((empty, 0), (some, 1)):
        path = Scratch(spark, "chats").path("out")
        chat.format_chats(df, path)
        assert chat.chat_digests(spark, path).count() == n


def test_parts_encode_as_the_whole():
    turns = [("user", prose(20, k)) for k in range(6)] + [("assistant", "\n x <"), ("user", "")]
    enc = Encoder("byte_bpe_50k.json")
    whole = enc.offsets(chat.render(turns)[0]).ids
    assert whole == [i for t in turns for i in enc.offsets(chat.render([t])[0]).ids]


# quality

def test_base_statistics_equal_a_plain_version():
    texts = [prose(40), "a b c d e f g h " * 6, "x\nx\n\n \nx y\nx", "", None, "# $ <a>\r\nq\x0bw", "one two three four five six seven eight nine " * 2, "é ü\nß é"] + ["\n".join(rng.choice(["a b", "c", "", " d e f"]) for _ in range(12)) for _ in range(60)]
    got = defaultdict(list)
    for _, _, w in blocks(pa.array(texts, pa.string()), block_bytes=200):
        for k, v in quality_rules.base_statistics(w).items():
            got[k] += v.tolist()
    for i, t in enumerate(texts):
        t = t or ""
        ws, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(ws[j : j + 8]) for j in range(len(ws) - 7)]
        cover = {j + k for j, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
        assert [got[k][i] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == [len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), dup, len(cover)], t


def test_scores_leave_the_document_out():
    texts = ["good words here now", "good words there", "bad things", "good words here now"]
    w = next(blocks(pa.array(texts)))[2]
    trusted = np.array([True, True, False, False])
    bucket, doc = quality_rules._buckets(w)
    raw, target = np.bincount(bucket, minlength=quality_rules.BUCKETS), np.bincount(bucket[trusted[doc]], minlength=quality_rules.BUCKETS)
    got = quality_rules.scores(w, trusted, raw, target)
    for d in range(4):
        own = bucket[doc == d]
        r, t = raw.astype(float), target.astype(float)
        np.subtract.at(r, own, 1)
        if trusted[d]:
            np.subtract.at(t, own, 1)
        p = lambda c: (c[own] + quality_rules.SMOOTH) / (c.sum() + quality_rules.SMOOTH * quality_rules.BUCKETS)  # noqa: B023, E731
        assert abs(got[d] - np.log(p(t) / p(r)).mean()) < 1e-8


def test_quality_rules_odd_rows(spark, odd):
    got = quality_rules.quality_rules(odd, odd.where("doc_id = 5")).collect()
    assert len(got) == odd.count() and all(r["base_failed"] for r in got if r["doc_id"] in (1, 2, 3, 4, 8))
    assert quality_rules.quality_rules(odd, none_of(spark, odd)).where("score <> 0").count() == 0
    assert quality_rules.quality_rules(none_of(spark, odd), odd).count() == 0


def test_quality_model_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.quality_scores(docs, labels).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    m = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    good, bad = m[m.quality == 1].score.to_numpy(), m[m.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert (good >= 0.3).mean() > 0.97 and got.score.between(0, 1).all()


def test_quality_model_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 1), (None, 1), (6, None), (7, 3)], "doc_id long, quality int")
    got = quality_model.quality_scores(odd, labels)
    assert got.count() == odd.count() and got.where("score IS NULL").count() == 0
    assert quality_model.quality_scores(odd, none_of(spark, labels)).where("score <> 0.5").count() == 0
    assert quality_model.quality_scores(none_of(spark, odd), labels).count() == 0


def test_quality_model_learns_once_from_a_repeated_id(spark):
    rows = [(i, prose(30, i)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    one, two = (spark.createDataFrame(r, "doc_id long, text string") for r in (rows * 4, rows[::-1] * 4))
    got = [sorted(map(tuple, quality_model.quality_scores(d, labels, sample=40).distinct().collect())) for d in (one, two)]
    assert got[0] == got[1] and len(got[0]) == 60


# decontamination

def test_decontamination(spark, odd):
    item = prose(40, 77)
    ws = item.split()
    edited = " ".join(w if k % 9 else "changed" for k, w in enumerate(ws))
    cut = " ".join(ws[5:25])
    docs = [(20, prose(200) + " " + item.upper() + " " + prose(50)), (21, prose(100) + " " + edited), (22, cut + " " + prose(30)), (23, prose(500)), (24, " ".join(reversed(ws)))]
    bench = spark.createDataFrame([(0, item), (1, None), (2, ""), (3, "xx yy"), (4, prose(30, 78))], "item_id long, text string")
    df = odd.select("doc_id", "text").union(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(df, bench).collect()}
    assert set(got) == {(20, 0), (21, 0), (22, 0)} and got[20, 0] == 40
    left = {r["doc_id"] for r in decontaminate.decontaminate(df, bench).collect()}
    assert left == {1, 2, 3, 4, 5, 6, 7, 8, 9, 23, 24, None}
    assert decontaminate.contaminated(df, none_of(spark, bench)).count() == 0
    assert decontaminate.contaminated(none_of(spark, df), bench).count() == 0


def test_alignment_equals_a_plain_version():
    for seed in range(40):
        r = random.Random(seed)
        a, b = ([r.randrange(4) for _ in range(r.randint(1, 12))] for _ in range(2))
        h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                best = max(best, h[i][j])
        assert decontaminate.align(np.array(a), np.array(b))[0] == best


def test_decontamination_equals_alignment_of_all_pairs(spark):
    r = random.Random(12)
    items = [prose(n, 900 + k) for k, n in enumerate((1, 2, 5, 8, 9, 12, 20, 20, 26, 38, 38, 60))]
    docs = []
    for item in items:
        ws = item.split()
        texts = [[x if k % every else "changed" for k, x in enumerate(ws, 1)] for every in (3, 4, 5, 6, 7)]
        texts.append([y for k, x in enumerate(ws, 1) for y in ([x] if k % 2 else [x, "added"])])
        for rate in (0.05, 0.1, 0.15, 0.2, 0.25, 0.3):
            for _ in range(4):
                texts.append([y for x in ws for y in ([x] if r.random() > rate else r.choice([["edited"], [], [x, "more"]]))])
        docs += [prose(r.randint(0, 30)).split() + t + prose(r.randint(0, 30)).split() for t in texts]
    docs += [items[9].split()] * 30 + [" ".join(items).split(), (items[9].split()[:2] * 40)]
    words = {x: k for k, x in enumerate({x for t in [*docs, *(i.split() for i in items)] for x in t})}
    code = lambda ws: np.array([words[x] for x in ws])
    want = {}
    for d, t in enumerate(docs):
        for i, item in enumerate(items):
            score = decontaminate.align(code(item.split()), code(t))[0]
            if score >= decontaminate.needed(len(item.split())):
                want[d, i] = score
    df = spark.createDataFrame(list(enumerate(map(" ".join, docs))), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]): x["score"] for x in decontaminate.contaminated(df, bench).collect()} == want


# lines

def test_within_edits_equals_levenshtein(spark):
    rows = []
    for _ in range(1500):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "z"])
        rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for k in (1, 2, 3):
        assert df.where(line_dedup.within_edits("a", "b", k) != (F.levenshtein("a", "b") <= k)).count() == 0


def near(a, b, k=2):
    if abs(len(a) - len(b)) > k:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1] <= k


def test_line_dedup_equals_brute_force(spark):
    bases, docs = [prose(9, k) for k in range(12)], []

    def vary(t):
        s = list(t)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(s))
            s[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "zz"])
        return "".join(s)

    hot = prose(14, 99)
    for i in range(70):  # and one line whose many versions share segments
        docs.append((i, "\n".join([vary(rng.choice(bases)) for _ in range(3)] + ["short", hot[:-3] + f"{i:03d}", "exactly the same line"])))
    lines = {}
    for i, t in docs:
        for k, x in enumerate(t.split("\n")):
            lines.setdefault(x, (i, k))
    up = {x: x for x in lines}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    long = [x for x in lines if len(x) >= line_dedup.NEAR_CHARS]
    for k, x in enumerate(long):
        for y in long[:k]:
            if find(x) != find(y) and near(x, y):
                up[find(x)] = find(y)
    first = {}
    for x, at in lines.items():
        first[find(x)] = min(first.get(find(x), at), at)
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if first[find(x)] == (i, k)) for i, t in docs}
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("hot, depth, wide, short_chars, near_chars", [(16, 6, 256, 20, 40), (3, 2, 0, 20, 40), (2, 1, 8, 4, 20)])
def test_line_dedup_of_short_lines_equals_brute_force(spark, monkeypatch, hot, depth, wide, short_chars, near_chars):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "DEPTH", depth)
    monkeypatch.setattr(line_dedup, "WIDE", wide)
    r, docs = random.Random(8), []
    bases = [(prose(20, 300 + n)[: n - 1] + ".") for n in (1, 2, 5, 12, 19, 20, 21, 22, 30, 38, 39, 40, 41, 42) for _ in range(2)] + ["Licensed under CC BY-NC 4.0.", "}"]
    for i in range(90):
        lines = ["", "  "]
        for _ in range(4):
            t = list(r.choice(bases))
            for _ in range(r.randint(0, 2)):
                k = r.randrange(len(t) + 1)
                t[k : k + r.randint(0, 1)] = r.choice(["", "q", "z"])
            lines.append("".join(t))
        docs.append((i, "\n".join(lines)))
    docs += [(90 + i, "same head of the" + f" {i:03d} line") for i in range(80)]  # versions of one line share a segment
    for i in range(60):  # versions that are mostly too far from one another
        t = list(prose(14, 99))
        for _ in range(r.randint(1, 4)):
            t[r.randrange(len(t))] = r.choice("qz")
        docs.append((170 + i, "".join(t)))
    first = {}
    for i, t in docs:
        for k, x in enumerate(t.split("\n")):
            if x.strip():
                first.setdefault(x, (i, k))
    up = {x: x for x in first}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in up:
        for y in up:
            least = min(len(x), len(y))
            if x < y and least >= short_chars and find(x) != find(y) and near(x, y, 1 if least < near_chars else 2):
                up[find(x)] = find(y)
    for x, at in list(first.items()):
        first[find(x)] = min(first[find(x)], at)
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip() or first[find(x)] == (i, k)) for i, t in docs}
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), short_chars=short_chars, near_chars=near_chars).collect()}
    assert got == want


def test_line_dedup_keeps_few_pairs_of_versions_that_are_far_apart(spark, monkeypatch):
    r, pairs = random.Random(5), []
    linked = line_dedup._linked
    monkeypatch.setattr(line_dedup, "HOT", 4)
    monkeypatch.setattr(line_dedup, "_linked", lambda found, *rest: pairs.append(found.distinct().count()) or linked(found, *rest))
    base = prose(12, 77)
    docs = [(i, base + f" {r.randrange(10**8):08d}") for i in range(300)]
    docs += [(300, docs[7][1][:-1] + "x"), (301, docs[8][1][:-2] + "xy")]
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i for i, t in got.items() if t == ""} == {300, 301}
    assert sum(pairs) < 5 * len(docs)


def test_line_dedup_looks_for_the_middle_on_one_side(spark):
    base = "".join(rng.choice("abcdefghij") for _ in range(60))
    for a, b in ((base[:10] + "z" + base[10:50] + base[51:], base), (base, base[:10] + "z" + base[10:50] + base[51:])):
        lines = spark.createDataFrame([(1, a, 60), (2, b, 60)], "id long, line string, n int")
        keyed = line_dedup.segments(line_dedup.seeds(lines, 2, 20, 40), 2).where("equal OR NOT own").collect()
        same = [k for k in keyed if k["own"] and any(x["key"] == k["key"] and x["id"] != k["id"] for x in keyed)]
        assert len(same) == 1
    assert [x for x in line_dedup.segment_shapes(2) if x[:2] == (2, 0)] == [(2, 0, True, 1, 0), (2, 0, True, 2, 0), (2, 0, False, 2, 1), (2, 0, True, 3, 0)]


def test_line_dedup_odd_rows(spark, odd):
    got = line_dedup.dedup_lines(odd)
    assert got.count() == odd.count() and set(got.columns) == {*odd.columns, "n_dropped"}
    rows = {(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in got.collect()}
    assert (1, 0, 0) in rows and (2, 1, 0) in rows and (6, 1, 1) in rows and (5, 1, 0) in rows
    assert line_dedup.dedup_lines(none_of(spark, odd)).count() == 0


# urls

def test_url_verdicts(spark):
    urls = {"http://a.net/x": ("a.net", "/x", "net/", "block"), "https://EXAMPLE.net/en/1": ("example.net", "/en/1", "example.net/en/", "allow"), "http://x.example.com/de/5?q": ("x.example.com", "/de/5", "example.com/de/", "block"), "http://b.org/fr/#f": ("b.org", "/fr/", "org/fr/", "allow"), "http://b.org/en/": ("b.org", "/en/", None, "allow"), "nothing": ("", "", None, "allow"), "http://a.net": ("a.net", "", None, "allow"), "http://h?x=/p": ("h", "", None, "allow"), "http://h#/p": ("h", "", None, "allow"), "x://y://z/w": ("y:", "//z/w", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow")}
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("shape", F.lit(1))
    got = {r["page_id"]: tuple(r)[1:5] for r in url_filter.url_verdicts(df).collect()}
    assert got == dict(enumerate(urls.values()))
    assert url_filter.url_verdicts(none_of(spark, df)).count() == 0


def test_templates_reject_by_purity(spark):
    rows = [(k, f"http://h.com/spam/{k}", True if k < 30 else None) for k in range(40)] + [(100 + k, f"http://h.com/ham/{k}", False if k < 30 else None) for k in range(40)]
    rows += [(200 + k, f"http://h.com/tag/word{chr(97 + k % 26)}{chr(97 + k // 26)}/list", None) for k in range(60)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[2] is not None], "page_id long, blocked boolean")
    got = {r["page_id"]: (r["verdict"], r["template"]) for r in url_filter.url_verdicts(pages, (), labels).collect()}
    assert {got[k][0] for k in range(40)} == {"block"} and {got[100 + k][0] for k in range(40)} == {"allow"}
    assert {got[200 + k][1] for k in range(60)} == {"tag/{w}/list"}


def test_templates_reject_pages_outside_the_rules(spark):
    words = [w * 3 for w in "abcdefghijkl"]
    rules = [("block", f"h.com/offers/{w}/") for w in words[:10]] + [("allow", f"h.com/news/{w}/") for w in words[:10]] + [("block", "h.com/forum/aaa/")]
    urls = {f"http://h.com/{top}/{w}/{k}": "block" if top == "offers" or (top, w) == ("forum", "aaa") else "allow" for top in ("offers", "news", "forum") for w in words for k in range(12)}
    urls |= {f"http://h.com/{top}/lll/{k}/reply": "allow" for top in ("offers", "news") for k in range(12)}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.url_verdicts(pages, rules).collect()}
    assert {k: v for k, (_, v) in got.items()} == dict(enumerate(urls.values()))
    assert sum(rule is None and v == "block" for rule, v in got.values()) == 24


def test_templates_tell_deep_branches_apart(spark):
    deep = "/".join("abcdefghij"[:9])
    rows = [(k, f"http://h.com/{deep}/{'bad' if k < 30 else 'good'}/{k}", k < 30) for k in range(60)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(k, b) for k, _, b in rows if k % 30 < 20], "page_id long, blocked boolean")
    got = {r["page_id"]: (r["verdict"], r["template"]) for r in url_filter.url_verdicts(pages, (), labels).collect()}
    assert got == {k: ("block", f"{deep}/bad/{{n}}") if b else ("allow", f"{deep}/good/{{n}}") for k, _, b in rows}
