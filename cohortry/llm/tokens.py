"""Token ids of whole texts, as the vocabulary's own library gives them.

For byte-level vocabularies a pre-token never spans the place where white space follows something else, so a
text may be cut there and each distinct piece encoded by the library once; a bounded per-worker memory keeps
the pieces' ids.  The words of a batch are cut, numbered and put together again as arrays, so that the memory is asked once
for each distinct one.  Texts whose white space makes those cuts unsafe are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces in one of the two generations that a worker remembers: when the younger is full, it becomes the older,
#: from which pieces are taken over when they are met again.
MEMORY = 600_000
#: White space as Python has it, for Arrow's regular expressions.
_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_PIECE = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: Marks that end a word of letters: a pre-token of their own.
_MARKS = r"""!"#$%&()*+,-./:;<=>?@[\]^`{|}~"""
#: Pieces in one call to the library, and in one of its texts: it takes less time for a piece of a short text.
JOINED, SHORT = 4096, 64
_IDS = [struct.Struct(f"<{n}I") for n in range(32)]
_encoders: dict[str, Encoder] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabulary file is; a path is taken as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str) -> Encoder:
    """The worker's encoder for a vocabulary."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def cuts_are_safe(model) -> bool:
    """Whether texts may be cut before a space that follows no white space, and between letters and the marks behind them: a plain
    byte-level pre-tokenizer, nothing before it, and no added token that could lie across a cut or take up spaces."""
    pre = json.loads(model.pre_tokenizer.__getstate__()) if model.pre_tokenizer else {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space", True) or not pre.get("use_regex", True) or model.normalizer is not None:
        return False
    mixed = re.compile(f"[^\\W\\d_]*[{re.escape(_MARKS)}]*")
    return not any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) or mixed.fullmatch(t.content) for t in model.get_added_tokens_decoder().values())


def _strings(found: pa.Array) -> list[str]:
    return found.to_numpy(zero_copy_only=False).tolist()


class _Ragged:
    """Lists of ids, one behind the other."""

    def __init__(self, lists: list[bytes], ids: np.ndarray | None = None, size: np.ndarray | None = None):
        self.ids = np.frombuffer(b"".join(lists), "<u4") if ids is None else ids
        self.size = np.fromiter(map(len, lists), np.int64, len(lists)) // 4 if size is None else size
        self.start = np.cumsum(self.size) - self.size

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the lists named, one list behind the other, and where each one's end."""
        n = self.size[which]
        ends = np.cumsum(n)
        at = np.repeat(self.start[which] - ends + n, n)
        at += np.arange(len(at))
        return self.ids[at], ends


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, without added special tokens."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = vocabulary(name)
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.older: dict[str, dict[str, bytes]] = {"": {}, " ": {}}
        self.by_piece = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.many = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.many = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
            self.offsets = lambda text: model.encode(text, add_special_tokens=False)
            self.model = model
            self.one = model.model.tokenize
            self.by_piece = cuts_are_safe(model)
            if self.by_piece:
                vocab = model.get_vocab(with_added_tokens=False)
                self.width = np.zeros(1 + max([*vocab.values(), *model.get_added_tokens_decoder()]), np.int64)
                self.width[list(vocab.values())] = [len(t) for t in vocab]  # one character stands for one byte
                for k, t in model.get_added_tokens_decoder().items():
                    self.width[k] = len(t.content.encode())

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that begin with the space that is put before them here and end in no white space: no pre-token spans
        two of them, so the library gets many in one text and the ids' widths tell where each ends."""
        texts = [" " + " ".join(pieces[lo : lo + SHORT]) for lo in range(0, len(pieces), SHORT)]
        ids = np.concatenate([np.array(x, "<u4") for x in self.many(texts)])
        size = np.array([len(p) for p in pieces] if all(map(str.isascii, texts)) else [len(p.encode()) for p in pieces])
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(size + 1)) + 1
        raw, out, lo = ids.tobytes(), [], 0
        for hi in (4 * ends).tolist():
            out.append(raw[lo:hi])
            lo = hi
        return out

    def _letters(self, words: list[str], lead: str) -> list[bytes]:
        """Ids of words of ASCII letters behind lead: one pre-token each, so the library's model gets them without its pre-tokenizer."""
        one, lead = self.one, lead and "\u0120"
        return [_IDS[len(x)].pack(*x) if len(x) < len(_IDS) else np.array(x, "<u4").tobytes() for x in ([t.id for t in one(lead + w)] for w in words)]

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in self.many(texts)]

    def _learn(self, memory: dict[str, bytes], missing: set[str], lead: str) -> None:
        """Take pieces that the memory lacks into it."""
        if len(memory) > MEMORY:
            self.older[lead] = dict(memory)
            memory.clear()
        older = self.older[lead]
        if older:
            again = [p for p in missing if p in older]
            memory.update(zip(again, map(older.__getitem__, again)))
            missing.difference_update(again)
        letters = [p for p in missing if p.isascii() and p.isalpha()]
        memory.update(zip(letters, self._letters(letters, lead)))
        missing.difference_update(letters)
        if lead:
            alone = [p for p in missing if p and not p[-1].isspace()]
            for lo in range(0, len(alone), JOINED):
                memory.update(zip(alone[lo : lo + JOINED], self._joined(alone[lo : lo + JOINED])))
            missing.difference_update(alone)
        rest = list(missing)
        memory.update(zip(rest, self._bytes([lead + p for p in rest])))

    def _ids(self, pieces: list[str], lead: str) -> list[bytes]:
        """Ids of pieces behind lead, from the memory, which learns those it lacks."""
        memory = self.spaced if lead else self.known
        found = list(map(memory.get, pieces))
        if None in found:
            self._learn(memory, {p for p, x in zip(pieces, found) if x is None}, lead)
            found = [memory[p] if x is None else x for p, x in zip(pieces, found)]
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        ids, ends = self.flat(texts)
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        return [raw[lo:hi] for lo, hi in zip([0, *ends], ends)]

    def flat(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text behind the other, and where each one's end; null counts as empty."""
        if not self.by_piece:
            found = _Ragged(self._bytes([t or "" for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)]))
            return found.ids, np.cumsum(found.size)
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        texts = texts.cast(pa.large_string()) if texts.nbytes > 1 << 28 else texts
        odd, lines = (pc.match_substring_regex(texts, x).to_numpy(zero_copy_only=False) for x in (f"{_BLANK} ", f"{_BLANK}\n|\n{_BLANK}"))
        kind, ids, size = np.where(odd, 2, lines), [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for k in np.unique(kind).tolist():
            some = texts.filter(pa.array(kind == k))
            if k == 2:
                found = _Ragged(self._spaced(some.to_pylist()))
                ids.append(found.ids)
                size.append(found.size)
            else:
                found, ends = self._plain(some, k == 0)
                ids.append(found)
                size.append(np.diff(ends, prepend=0))
        ids, size = np.concatenate(ids), np.concatenate(size)
        if len(set(kind.tolist())) < 2:
            return ids, np.cumsum(size)
        return _Ragged([], ids, size).take(np.argsort(np.argsort(kind, kind="stable"), kind="stable"))

    def _plain(self, texts: pa.Array, lines: bool) -> tuple[np.ndarray, np.ndarray]:
        """flat for texts in which no white space is followed by a space: they may be cut at all spaces; lines: around line ends
        too, as none has white space beside it."""
        # a line end between spaces is a piece of its own, and no space stands before it or what follows it
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " \n ") if lines else texts, " ")
        bounds = pieces.offsets.to_numpy().astype(np.int64) - pieces.offsets[0].as_py()
        numbered = pieces.flatten().dictionary_encode()
        words, code = numbered.dictionary, numbered.indices.to_numpy().astype(np.int64)
        bare = np.zeros(len(code) + 1, bool)
        if lines and (end := pc.index(words, "\n").as_py()) >= 0:
            bare[:-1] = code == end
            bare[1:] |= bare[:-1]
        bare[bounds[:-1]] = True
        code[bare[:-1]] += len(words)
        used = np.zeros(2 * len(words), bool)
        used[code] = True
        place = np.cumsum(used) - 1
        tables = [self._words(words.filter(pa.array(x)), lead) for x, lead in zip(np.split(used, 2), (" ", ""))]
        ids, ends = _Ragged([], *(np.concatenate(x) for x in zip(*tables))).take(place[code])
        return ids, ends[bounds[1:] - 1]

    def _words(self, words: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words behind lead, one word behind the other, and how many each has."""
        # words of letters and the marks behind them are known apart
        stems = pc.utf8_rtrim(words, _MARKS)
        longer = pc.and_(pc.utf8_is_alpha(stems), pc.less(pc.binary_length(stems), pc.binary_length(words)))
        marked = words.filter(longer)
        n_marks = pc.subtract(pc.binary_length(marked), pc.binary_length(stems.filter(longer)))
        tails = [w[-n:] for w, n in zip(_strings(marked), n_marks.to_numpy().tolist())]
        distinct = {t: k for k, t in enumerate(dict.fromkeys(["", *tails]))}
        numbered = pc.if_else(longer, stems, words).dictionary_encode()
        tail = np.zeros(len(words), np.int64)
        tail[longer.to_numpy(zero_copy_only=False)] = [distinct[t] for t in tails]
        table = _Ragged(self._ids(_strings(numbered.dictionary), lead) + self._ids(list(distinct), ""))
        ids, ends = table.take(np.stack([numbered.indices.to_numpy(), len(numbered.dictionary) + tail], 1).ravel())
        return ids, np.diff(ends[1::2], prepend=0)

    def _spaced(self, texts: list[str]) -> list[bytes]:
        cut = {t: _PIECE.findall(t) for t in texts if not _ODD.search(t)}
        pieces = list(set().union(*cut.values()))
        ids = dict(zip(pieces, self._ids(pieces, "")))
        whole = [t for t in dict.fromkeys(texts) if t not in cut]
        entire = dict(zip(whole, self._bytes(whole)))
        return [entire[t] if t in entire else b"".join(map(ids.__getitem__, cut[t])) for t in texts]
