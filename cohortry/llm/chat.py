"""Chat formatting with offset-aligned loss masks.

A turn is rendered ``<turn:ROLE>TEXT</turn>`` and a line feed; ``\\``, ``<`` and ``>`` inside roles and texts
become ``\\b``, ``\\l`` and ``\\g``, so no text can hold a control string and the text can be had back.  A
conversation is rendered whole and encoded once with offsets.  One whose turns fall into several blocks of
BLOCK_TURNS turn numbers, or with a block of over PART_CHARS characters, is stored in parts that its own turns decide.  Parts end
between turns, where no token can span (a line feed before ``<`` is a pre-token of its own, which is tried for the
vocabulary at hand), so their ids are those of the whole.  The mask marks the tokens that meet an assistant's text: both kinds of span are sorted, and the
first and last token of each turn are found by binary search.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

#: Turn numbers of a block, and characters from which on a part of it ends.
BLOCK_TURNS, PART_CHARS = 256, 1 << 18
_TURN = re.compile(r"<turn:([^<>]*)>([^<>]*)</turn>\n")
_BACK = {"b": "\\", "l": "<", "g": ">"}
_PART = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("ord", pa.int64()), ("rendered", pa.string()), ("ids", pa.binary()), ("offsets", pa.binary()), ("mask", pa.binary()), ("spans", pa.binary())])
_PART_SQL = "conv_id long, block long, ord long, rendered string, ids binary, offsets binary, mask binary, spans binary"


def escape(text: str) -> str:
    return text.replace("\\", "\\b").replace("<", "\\l").replace(">", "\\g")


def unescape(text: str) -> str:
    return re.sub(r"\\([blg])", lambda m: _BACK[m[1]], text)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The rendered turns, and the span of each text whose role is to be learned."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"<turn:{escape(role)}>", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}</turn>\n")
        at += len(out[-1])
    return "".join(out), spans


def mask_tokens(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """1 for every token that shares a character with a span; both are sorted by start."""
    mask = np.zeros(len(offsets), np.uint8)
    lo, hi = np.searchsorted(offsets[:, 1], spans[:, 0], "right"), np.searchsorted(offsets[:, 0], spans[:, 1], "left")
    for a, b in zip(lo.tolist(), hi.tolist()):
        mask[a:b] = 1
    return mask


def masked_text(rendered: str, offsets: np.ndarray, mask: np.ndarray, spans: np.ndarray) -> list[str]:
    """What lies under the mask within each span, unescaped; bytes of one character give it once."""
    out, lo, hi = [], np.searchsorted(offsets[:, 1], spans[:, 0], "right"), np.searchsorted(offsets[:, 0], spans[:, 1], "left")
    for (s, e), a, b in zip(spans.tolist(), lo.tolist(), hi.tolist()):
        at, parts = s, []
        for k in range(a, b):
            x, y = max(int(offsets[k, 0]), at), min(int(offsets[k, 1]), e)
            if mask[k] and x < y:
                parts.append(rendered[x:y])
                at = y
        out.append(unescape("".join(parts)))
    return out


def _cuts_hold(enc) -> bool:
    """Whether the vocabulary never joins the end of a turn with the start of the next one."""
    one, two = "</turn>\n", "<turn:"
    return list(enc.offsets(one + two).ids) == [*enc.offsets(one).ids, *enc.offsets(two).ids]


def _format_rows(vocab: str, learn: str):
    def rows(batches):
        enc = encoder(vocab)
        own, ord_, turns, size = None, 0, [], 0

        def part():
            text, spans = render(turns, learn)
            e = enc.offsets(text)
            offsets, spans = np.array(e.offsets, "<i4").reshape(-1, 2), np.array(spans, "<i4").reshape(-1, 2)
            return {"conv_id": own[0], "block": own[1], "ord": ord_, "rendered": text, "ids": np.array(e.ids, "<u4").tobytes(), "offsets": offsets.tobytes(), "mask": mask_tokens(offsets, spans).tobytes(), "spans": spans.tobytes()}

        for b in batches:
            out = []
            for c, block, role, text in zip(*(b[k].to_pylist() for k in ("conv_id", "block", "role", "text"))):
                if turns and ((c, block) != own or size > PART_CHARS):
                    if c == own[0] and not _cuts_hold(enc):
                        raise ValueError(f"{vocab} has tokens across the ends of turns; a long conversation can't be stored in parts")
                    out.append(part())
                    ord_ = ord_ + 1 if (c, block) == own else 0
                    turns, size = [], 0
                own = (c, block)
                turns.append((role or "", text or ""))
                size += len(text or "")
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_PART)
        if turns:
            yield pa.RecordBatch.from_pylist([part()], schema=_PART)

    return rows


def format_chats(conversations: DataFrame, path: str, vocab: str = "byte_bpe_50k.json", learn: str = "assistant") -> None:
    """Write rendered conversations with ids, offsets and masks to path, as parts in order.

    conversations needs conv_id, turn, role and text; turns go by turn (null first), equal ones by role and
    text, repeated rows stay.  A null role or text is empty; rows without conv_id make one conversation.  A
    long conversation is dealt to several tasks by blocks of its turn numbers; rows that all have one turn number (or none)
    are one block, which a task streams without holding it.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.floor(F.col("turn") / BLOCK_TURNS).cast("long").alias("block"), "turn", "role", "text")
    rows = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
    rows.mapInArrow(_format_rows(vocab, learn), _PART_SQL).write.mode("overwrite").parquet(path)


def _digest_rows(batches):
    conv, state = None, None
    out = []

    def done():
        n, turns, chars, loss, size = state
        out.append({"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size})

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    for b in batches:
        for r in b.to_pylist():
            if state is None or r["conv_id"] != conv:
                if state:
                    done()
                conv, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text = r["rendered"]
            for m in _TURN.finditer(text):
                state[0] += 1
                state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            offsets, spans = (np.frombuffer(r[k], "<i4").reshape(-1, 2) for k in ("offsets", "spans"))
            for t in masked_text(text, offsets, np.frombuffer(r["mask"], np.uint8), spans):
                state[2] += len(t)
                state[3].update(t.encode())
            state[4] += len(text)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
    if state:
        done()
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def chat_digests(spark, path: str) -> DataFrame:
    """One row per stored conversation: what its turns and its masked text are, from the files alone."""
    parts = spark.read.schema(_PART_SQL).parquet(path).select("conv_id", "block", "ord", "rendered", "offsets", "mask", "spans")
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "block", "ord")  # SHA-256 of a conversation needs its order
    return parts.mapInArrow(_digest_rows, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
