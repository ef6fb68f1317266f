"""Packing of tokenised documents into training sequences (operator 7).

Method: bounded-space online packing. Each partition keeps a fixed number of open
windows. A document's full windows are emitted at once; its rest goes to the open window
that it fills best. When no open window takes it, a new one is opened, or, where all are
in use, the fullest is topped up with the start of the rest and emitted. What is still
open at the end of a partition (``open_windows`` windows at most, with their ids) is
merged in a second stage over groups of partitions, again into full windows. The last,
partly filled window of a group is cut into sequences whose lengths are powers of two,
which need no padding.

The merge stage reads at most ``open_windows * length`` ids from a partition, however
large the input is, and ``merged_partitions`` partitions at a time.

Cases: a null or empty text is the end token alone; a text longer than a window spans
several sequences; repeated rows and ids are packed as often as they come; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Known, in_slices, packed, saved

# Texts of these characters alone are unchanged by NFC and lower-cased one by one alike
# everywhere, to characters of this set; within them words can be looked up. Others go to
# the tokenizer whole. Not among them is U+0130, whose lower case is two characters.
PLAIN = re.compile(r"[\t\n\r\x20-\x7E\xA1-įı-ſ‐-‧]*")
PLAIN_BYTES = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x100)])  # those of Latin-1
# What the vocabulary's own file takes for words, for the characters of PLAIN
# in lower case: endings after an apostrophe, runs of letters, single digits, other runs.
LETTERS, DIGITS = "a-zA-Zªµº\xC0-\xD6\xD8-\xF6\xF8-ſ", "0-9²³¹¼-¾"
WORDS = re.compile(rf"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+")
# The steps of a file for which the above holds, as the file states them.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# The byte-level alphabet: visible bytes stand for themselves, the others for 256 and on.
VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in VISIBLE)}


class WordTokenizer:
    """Ids as the tokenizer gives them without special tokens, remembering known words.

    Where the file says that its normaliser is NFC, white space to blanks and lower case,
    and that it splits words by ``SPLIT`` into the byte-level alphabet, no word spans white
    space: a text is cut there, and each piece's ids are looked up. For any other file
    every text goes to the tokenizer whole. At most twice ``cached_words`` words and
    pieces are held, and what a text adds.
    """

    def __init__(self, path: str, cached_words: int = 200_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.by_words, self.cached_words = self._splits_plainly(), cached_words
        self.forget()

    def forget(self) -> None:
        """Let go of all known words."""
        self.words, self.pieces = Known(self._word, {}), Known(self._piece, {})

    def _splits_plainly(self) -> bool:
        file = json.loads(self.tokenizer.to_str())
        steps = (file["normalizer"] or {}).get("normalizers", [])
        splits = (file["pre_tokenizer"] or {}).get("pretokenizers", [])
        return (
            [x["type"] for x in steps] == NORMALIZERS
            and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
            and [x["type"] for x in splits] == ["Split", "ByteLevel"]
            and (splits[0]["pattern"], splits[0]["behavior"], splits[0]["invert"]) == ({"Regex": SPLIT}, "Removed", True)
            and not (splits[1]["add_prefix_space"] or splits[1]["use_regex"])
        )

    def _word(self, word: str) -> bytes:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(ALPHABET)
        return packed(t.id for t in self.tokenizer.model.tokenize(letters))

    def _piece(self, piece: str) -> bytes:
        words = WORDS.findall(piece)
        if words == [piece]:
            words = [piece]  # both tables hold the same string
        return b"".join(map(self.words.__getitem__, words))

    @staticmethod
    def _plain(text: str) -> bool:
        try:
            return not text.encode("latin-1").translate(None, PLAIN_BYTES)
        except UnicodeEncodeError:
            return PLAIN.fullmatch(text) is not None

    def encode(self, text: str) -> bytes:
        """The ids, packed."""
        if not self.by_words or not self._plain(text) or any(s in text for s in self.specials):
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        for name, most in (("words", self.cached_words), ("pieces", self.cached_words * 5 // 8)):
            if len(held := getattr(self, name)) >= most:
                held.older = {}
                setattr(self, name, Known(held.make, held))
        return b"".join(map(self.pieces.__getitem__, text.lower().split()))


@cache
def worker_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for all tasks of a Python worker; each task lets go of the words that it has learned."""
    return WordTokenizer(path)


COLUMNS = "id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Out:
    """Rows of pieces, with ids only for windows that are still open."""

    def __init__(self, kind: pa.DataType):
        self.kind, self.rows = kind, []

    def add(self, doc, start, ids: bytes, total, sequence, offset, keep_ids=False):
        self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, ids if keep_ids else None))

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) if self.rows else [()] * 8
        self.rows = []
        kinds = [self.kind, *[pa.int64()] * 6, pa.binary()]
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    length: int = 2048,
    end_id: int = 1,
    open_windows: int = 16,
    merged_partitions: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: document, its place there, its sequence and its place in it."""
    kind, end = docs.schema[id_col].dataType.simpleString(), packed([end_id])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(tokenizer_path)
        base, made, out = TaskContext.get().partitionId() << 32, 0, None
        windows: list[list] = []  # of [free, [(doc, start, ids, total)]]

        def emit(pieces, keep=False):
            nonlocal made
            at = 0
            for doc, start, ids, total in pieces:
                out.add(doc, start, ids, total, base + made, at, keep)
                at += len(ids) // 4
            made += 1

        for part in in_slices(batches, 256):
            out = out or _Out(part.column(0).type)
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = tokenizer.encode(text or "") + end
                total, at = len(ids) // 4, 0
                while total - at >= length:
                    emit([(doc, at, ids[4 * at : 4 * (at + length)], total)])
                    at += length
                while at < total:
                    rest = total - at
                    best = min((w for w in windows if w[0] >= rest), key=lambda w: w[0], default=None)
                    if best is None and len(windows) < open_windows:
                        best = [length, []]
                        windows.append(best)
                    if best is None:
                        best = min(windows, key=lambda w: w[0])
                    n = min(rest, best[0])
                    best[1].append((doc, at, ids[4 * at : 4 * (at + n)], total))
                    best[0] -= n
                    at += n
                    if not best[0]:
                        windows = [w for w in windows if w is not best]
                        emit(best[1])
            yield out.take()
        tokenizer.forget()
        for _, pieces in windows:
            emit(pieces, True)
        if out:
            yield out.take()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, pieces, have, group, made = None, [], 0, None, 0

        def cut(n):
            """Emit the next n ids as one sequence."""
            nonlocal pieces, have, made
            at, left = 0, n
            while left:
                doc, start, ids, total = pieces.pop(0)
                if len(ids) > 4 * left:
                    pieces.insert(0, (doc, start + left, ids[4 * left :], total))
                    ids = ids[: 4 * left]
                out.add(doc, start, ids, total, (1 << 62) + (group << 32) + made, at)
                at += len(ids) // 4
                left -= len(ids) // 4
            have -= n
            made += 1

        def finish():
            while have:
                cut(1 << (have.bit_length() - 1))

        for part in in_slices(batches, 64):
            out = out or _Out(part.column("id").type)
            names = ("id", "start", "ids", "doc_tokens", "merge_group")
            for doc, start, ids, total, g in zip(*(part.column(c).to_pylist() for c in names)):
                if g != group:
                    finish()
                    group, made = g, 0
                pieces.append((doc, start, ids, total))
                have += len(ids) // 4
                while have >= length:
                    cut(length)
            yield out.take().select(out_names)
        if out:
            finish()
            yield out.take().select(out_names)

    columns = COLUMNS.format(id=kind)
    out_names = [c.split()[0] for c in columns.split(", ")]
    first = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(fill, columns + ", ids binary")
    first = saved(first, "packed")
    group = F.shiftright(F.shiftright("sequence_id", 32), merged_partitions.bit_length() - 1)
    still_open = first.where(F.col("ids").isNotNull()).withColumn("merge_group", group)
    merged = (
        still_open.repartition("merge_group")
        .sortWithinPartitions("merge_group", "sequence_id", "offset")
        .select("id", "start", "ids", "doc_tokens", "merge_group")
        .mapInArrow(merge, columns)
    )
    done = first.where(F.col("ids").isNull()).drop("ids")
    return done.unionByName(merged).withColumnRenamed("id", id_col)
