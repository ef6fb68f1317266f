"""Byte-level BPE encoding and decoding (operator 5).

Method: bytes are mapped to Latin-1 characters so that a pyahocorasick automaton over
the vocabulary finds the longest token at any position. From the longest match the
encoder goes forward; where the new token and the one before it could not stand side by
side in a merged text, it tries the next shorter token that is a prefix, and where none
is left it steps back. A sequence in which all neighbours are compatible is exactly the
result of applying the merges by rank, and each position is given up at most once, so
the time is linear. Compatibility of neighbours is memoised.

Texts are first cut before single blanks where the pattern allows, and what is known of the
pieces is looked up.

Cases: a null text counts as empty; an empty text has no tokens; texts of any length are
encoded whole; equal rows give equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Known, in_slices, packed


# Fixed value: the pattern for which texts may be cut before blanks.
CUT_AT_BLANKS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# White space but blanks and line ends, or a blank between line ends: such texts are not cut.
OTHER_SPACES = re.compile(r"[^\S \n]|\n \n").search


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class BytePairEncoder:
    """Encoder for rank files in which every single byte is a token and ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached_words: int = 400_000):
        self.ids = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.text_of = {rank: token for token, rank in self.ids.items()}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.length = {rank: len(token) for rank, token in self.text_of.items()}
        # The longest token that is a proper prefix of each.
        self.shorter = {rank: next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), None) for t, rank in self.ids.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        # No match of this pattern goes past a blank that stands alone, so texts are cut there.
        self.cuts, self.cached_words = pattern == CUT_AT_BLANKS, cached_words
        self.words, self.pieces = Known(lambda word: packed(self.encode_piece(word.encode("utf-8"))), {}), Known(self._piece, {})

    def _parts(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; a single byte is its own parts."""
        if (known := self.parts.get(token)) is not None:
            return known
        text = self.text_of[token]
        pieces = list(text)
        while len(pieces) > 2:
            rank, at = min((self.ids.get(pieces[i] + pieces[i + 1], 1 << 60), i) for i in range(len(pieces) - 1))
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        both = (self.ids[pieces[0]], self.ids[pieces[-1]]) if len(pieces) == 2 else (token, token)
        self.parts[token] = both
        return both

    def _compatible(self, left: int, right: int) -> bool:
        """True if merging the bytes of both gives exactly these two tokens.

        Undoing the later of the two tokens' merges step by step shows every pair that
        was ever adjacent at the seam; a merge across the seam that ranks before the
        one just undone would have come first.
        """
        if (known := self.fits.get((left, right))) is not None:
            return known
        a, b, before = left, right, 1 << 60
        while True:
            joined = self.ids.get(self.text_of[a] + self.text_of[b])
            if joined is not None and joined < before:
                fits = False
                break
            single_a, single_b = len(self.text_of[a]) == 1, len(self.text_of[b]) == 1
            if single_a and single_b:
                fits = True
                break
            # Of equal ranks the left token is made first: its seam is undone last.
            if not single_a and (single_b or a > b):
                before, a = a, self._parts(a)[1]
            else:
                before, b = b + 1, self._parts(b)[0]
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[left, right] = fits
        return fits

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        text = piece.decode("latin-1")
        whole = self.ids.get(text)
        if whole is not None:
            return (whole,)
        # One call finds the longest token at each step; the first pair that does not fit
        # is where the search with shorter tokens starts.
        tokens = [token for _, token in self.automaton.iter_long(text)]
        fits, length, shorter, automaton = self.fits, self.length, self.shorter, self.automaton
        last = None
        for i, token in enumerate(tokens):
            if last is not None and not (fits[last, token] if (last, token) in fits else self._compatible(last, token)):
                break
            last = token
        else:
            return tuple(tokens)
        del tokens[i:]
        at, n = sum(map(length.__getitem__, tokens)), len(text)
        open_at = bytearray(b"\x01") * (n + 1)
        while True:
            end = at + length[token]
            if open_at[end] and (last is None or (fits[last, token] if (last, token) in fits else self._compatible(last, token))):
                tokens.append(token)
                if end == n:
                    return tuple(tokens)
                at, last = end, token
                token = next(automaton.iter_long(text, at))[1]
                continue
            token = shorter[token]
            while token is None:
                open_at[at] = 0
                token = tokens.pop()
                at -= length[token]
                last = tokens[-1] if tokens else None
                token = shorter[token]

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(piece)))

    def encode(self, text: str) -> bytes:
        """The ids, packed as little-endian unsigned 32-bit numbers."""
        for name, most in (("words", self.cached_words), ("pieces", self.cached_words * 5 // 8)):
            if len(held := getattr(self, name)) >= most:
                setattr(self, name, Known(held.make, dict(held)))
        if not self.cuts or "  " in text or OTHER_SPACES(text):
            return b"".join(map(self.words.__getitem__, self.split(text)))
        first, *others = text.split(" ")
        return self.pieces[first] + b"".join(map(self.pieces.__getitem__, map(" ".__add__, others)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@cache
def worker_encoder(ranks_path: str, pattern: str) -> BytePairEncoder:
    """One encoder, with what it knows, for all tasks of a Python worker."""
    return BytePairEncoder(read_ranks(ranks_path), pattern)


def _lists(values: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(v) // 4 for v in values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(values), np.int32), pa.int32()))


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary): every whole text encoded, and its ids decoded again.

    The vocabulary file is read once per Python worker from ``ranks_path``, a file that
    every machine has; no shuffle. Both steps share one pass, so ids cross Arrow once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(ranks_path, pattern)
        for part in in_slices(batches, 128):
            encoded, decoded = [], []
            for text in part.column(1).to_pylist():
                ids = encoder.encode(text or "")
                encoded.append(ids)
                decoded.append(encoder.decode(np.frombuffer(ids, np.int32).tolist()))
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(encoded), pa.array(decoded, pa.binary())], ["id", "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every whole text."""
    return round_trip(df, ranks_path, pattern, id_col, text_col).select(id_col, "ids")


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary): the bytes of given ids; null ids give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {rank: token for token, rank in read_ranks(ranks_path).items()}
        for part in in_slices(batches, 128):
            texts = [b"".join(map(bytes_of.__getitem__, ids or ())) for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary())], ["id", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def digests(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document the number of tokens and digests of the ids and of the decoded bytes."""
    return round_trip(df, ranks_path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
