"""Harmonic packing of token ids into training sequences.

A document's ids are cut into pieces: whole sequences of ``capacity``, then the powers of two of the
rest from the greatest down to ``least_cut``, then a tail shorter than that, uncut.  A piece of a length
in ``(capacity / (j + 1), capacity / j]`` belongs to class ``j``, and a bin of class ``j`` holds ``j``
pieces, so the pieces of powers of two fill their bins to the last place, and only bins of tails, which
are short and many to a bin, have room left, less than one more piece.  Each partition of the input
packs by itself with one open bin to a class, in one pass and without a shuffle.  The bins still open
at its end are cut into sequences of powers of two, which need no padding.

The tokenizer is a file of the ``tokenizers`` library.  Where its rules allow, words are encoded apart and
kept in a bounded table.
"""

from __future__ import annotations

import json
import re
import struct

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, LEAST_CUT, END_ID = 2048, 64, 1
#: Words and parts of words kept by a worker, and the longest of them; a full table starts anew.
KEPT, KEPT_CHARS = 600_000, 64
_SEQUENCES = 1 << 36  # of a partition at most
_words = re.compile(r"[^\x20\x09-\x0D]+").findall
_other_space = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search

#: The text rules under which words between white space are encoded apart from each other.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Under them, runs of these letters and of these marks are the parts of a word that has no other characters.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r"!-&(-/:-@\[-`{-~"
_parts = re.compile(f"[{_LETTERS}]+|[{_MARKS}]+").findall
_plain = re.compile(f"[{_LETTERS}{_MARKS}]+").fullmatch


class _Words(dict):
    """Ids of words; one that is not there is encoded, and kept if it is short."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= KEPT_CHARS:
            self[word] = ids
        return ids


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, by a tokenizer's file.

    With the text rules above, each distinct word is encoded once, a plain one from its parts, which
    many words share.  With other rules whole texts are encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        rules = json.loads(self.tokenizer.to_str())
        self.apart = rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == PRE_TOKENIZER
        self.special = re.compile("|".join(sorted({re.escape(t["content"][:2]) for t in rules["added_tokens"]})) or r"(?!)").search
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.kept = _Words(self._word)
        self.kept_parts = _Words(self._part)

    def _part(self, part: str) -> bytes:
        found = [t.id for t in self.model.tokenize(part if part.isascii() else part.translate(self.bytes))]
        return struct.pack(f"<{len(found)}I", *found)

    def _encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        if _plain(word) and not self.special(word):
            return b"".join(map(self.kept_parts.__getitem__, _parts(word.lower())))
        return self._encode(word)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.apart:
            return [self._encode(t) if t else b"" for t in texts]
        out = []
        for text in texts:
            # split() knows further white space than the words' pattern.
            line = (_words(text) if _other_space(text) else text.split()) if text else []
            out.append(b"".join(map(self.kept.__getitem__, line)))
            if len(self.kept) > KEPT:
                self.kept.clear()
            if len(self.kept_parts) > KEPT:
                self.kept_parts.clear()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(n: int, capacity: int, least_cut: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids, in their order."""
    out, rest = [capacity] * (n // capacity), n % capacity
    size = 1 << capacity.bit_length()
    while size >= least_cut:
        if rest >= size:
            out.append(size)
            rest -= size
        size >>= 1
    return out + [rest] * (rest > 0)


class Packer:
    """The open bins of one worker; a piece is ``(row, start, ids)``."""

    def __init__(self, capacity: int, least_cut: int, first: int):
        self.capacity, self.least_cut, self.next = capacity, least_cut, first
        self.open: dict[int, list[tuple]] = {}

    def close(self, pieces: list[tuple]) -> list[tuple]:
        """A sequence of the pieces: ``(row, start, ids, sequence, offset)``."""
        out, at = [], 0
        for row, start, ids in pieces:
            out.append((row, start, ids, self.next, at))
            at += len(ids) // 4
        self.next += 1
        return out

    def add(self, row, ids: bytes) -> list[tuple]:
        """Take a document; the bins that it fills."""
        out, start = [], 0
        for n in cuts(len(ids) // 4, self.capacity, self.least_cut):
            piece, kind = (row, start, ids[4 * start:4 * (start + n)]), self.capacity // n
            start += n
            held = self.open.setdefault(kind, [])
            held.append(piece)
            if len(held) == kind:
                out += self.close(self.open.pop(kind))
        return out

    def finish(self) -> list[tuple]:
        """The bins that are not full, cut into sequences of powers of two."""
        out = []
        for kind in sorted(self.open):
            held = self.open[kind]
            total = sum(len(p[2]) for p in held) // 4
            for bit in reversed(range(total.bit_length())):
                part, room = [], 4 * (total & (1 << bit))
                while room:
                    row, start, ids = held[0]
                    part.append((row, start, ids[:room]))
                    held[0] = (row, start + len(part[-1][2]) // 4, ids[room:])
                    room -= len(part[-1][2])
                    if not held[0][2]:
                        del held[0]
                if part:
                    out += self.close(part)
        self.open = {}
        return out


def pack_tokens(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, least_cut: int = LEAST_CUT,
                end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset``: one row for each piece.

    ``ids`` are little-endian unsigned 32-bit numbers; each document ends with ``end_id``, so null,
    empty and blank texts are that one id.  ``capacity`` and ``least_cut`` are powers of two.  Rows are
    packed each, equal ones and those of null ids too; a text of any length is encoded whole.  A
    sequence is shorter than ``capacity`` and no power of two only where it holds tails.  ``docs`` is to
    be a table, whose partitions are the same when one is computed again.  Of its columns only
    ``doc_id`` and ``text`` are read.  An empty table gives no rows.
    """
    if capacity & (capacity - 1) or least_cut & (least_cut - 1) or not 0 < least_cut <= capacity:
        raise ValueError("capacity and least_cut must be powers of two")
    end = end_id.to_bytes(4, "little")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def batch(pieces: list[tuple]) -> pa.RecordBatch:
        rows, start, ids, number, offset = zip(*pieces)
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(
            ([r[0] for r in rows], start, [len(x) // 4 for x in ids], ids, [r[1] for r in rows], number, offset), schema)], schema=schema)

    def run(batches):
        encode = encoder(tokenizer).encode
        packer = Packer(capacity, least_cut, TaskContext.get().partitionId() * _SEQUENCES)
        for part in batches:
            for at in range(0, part.num_rows, 256):
                some = part.slice(at, 256)
                out = []
                for doc_id, ids in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist())):
                    ids += end
                    out += packer.add((doc_id, len(ids) // 4), ids)
                if out:
                    yield batch(out)
        if out := packer.finish():
            yield batch(out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, length, ids`` of the sequences of ``pack_tokens``; ``ids`` without padding."""
    place = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), place.alias("parts")).select(
        "sequence_id", "length", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"))
