"""SimHash near-duplicates by a byte-position inverted index (operator 6).

Method: a 64-bit fingerprint has a byte at each of eight positions. Fingerprints that
differ in at most 4 bits differ in at most 4 bytes, so they share at least 4 positional
bytes, and at least 3 of any 7 positions. The index therefore posts each fingerprint under
every choice of 3 positional bytes out of positions 0 to 6 (35 postings): a posting list
of a single byte holds a 256th of all rows and would grow with the input, one of three
bytes a 16-millionth. Within a list the shared positional bytes of each pair are tallied;
pairs that reach the minimum of 4 are verified by their differing bits.

Equal fingerprints are one node. A list longer than ``list_rows`` is split into parts, and
every pair of parts is a group of its own, so no task gets more than ``2 * list_rows``
postings of one list. From each group only the links of a spanning forest leave, which
keep all connections; pairs are never emitted.

Cases: null and blank texts have fingerprint zero; texts of fewer than four words are one
shingle; repeated rows share a fingerprint; a null doc_id counts only where a whole
component has no other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_key, fresh, join_groups, saved, text_function
from .components import components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
KEYS = list(combinations(range(7), 3))
BLOCK = 8192


def fingerprint_of(text: str | None, shingle_words: int = 4) -> int:
    """The unsigned fingerprint of a text."""
    words = (text or "").encode("utf-8").translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    # In blocks of shingles, so that a very long text needs no further lists of its length.
    for at in range(0, n, BLOCK):
        own = words[at : at + BLOCK + shingle_words - 1]
        shingles = min(BLOCK, n - at)
        joined = b" ".join(own)
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
        starts = np.concatenate([[0], ends[: shingles - 1] + 1]).tolist()
        stops = ends[-shingles:].tolist()
        hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts, stops)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text_col: str) -> Column:
    """The fingerprint of a text column, its 64 bits as a long."""

    def run(texts: pd.Series) -> pa.Array:
        return pa.array(np.array([fingerprint_of(t) for t in texts], np.uint64).view(np.int64))

    return text_function(run, T.LongType(), text_col)


def as_hex(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def forest(prints: np.ndarray, max_bits: int, min_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the graph of linked fingerprints (distinct, uint64)."""
    a, b = [], []
    left = np.sort(prints)
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            differ = left ^ x
            shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = shared >= min_bytes
            near[near] = np.bitwise_count(differ[near]) <= max_bits
            if near.any():
                found = left[near]
                a.append(np.full(len(found), x))
                b.append(found)
                front.extend(found)
                left = left[~near]
    empty = np.empty(0, np.uint64)
    return np.concatenate(a or [empty]), np.concatenate(b or [empty])


def links(prints: DataFrame, *, max_bits: int = 4, list_rows: int = 4096) -> DataFrame:
    """(a, b): links that connect what is connected among the distinct values of ``fp``.

    ``max_bits`` is at most 4: the index is built on the four shared bytes that follow.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("max_bits must be 0 to 4")
    byte = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(255) for i in range(7)]
    keys = [F.lit(k << 24) + F.shiftleft(byte[i], 16) + F.shiftleft(byte[j], 8) + byte[m] for k, (i, j, m) in enumerate(KEYS)]
    postings = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / list_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts.cast("long")).cast("int")
    # Hot lists meet their sizes by a bounded broadcast, and are split before they are dealt by key.
    shared = join_groups(postings, sizes, ["key"], "n", prints.count() * len(KEYS)).select("key", "fp", parts.alias("parts"), own.alias("own"))
    pairs = shared.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    groups = pairs.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def close(rows: list) -> pa.RecordBatch:
            a, b = forest(np.concatenate(rows).view(np.uint64), max_bits, 4)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, i, j, fp = (batch.column(c).to_numpy() for c in range(4))
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            bounds = [0, *cuts.tolist(), len(key)]
            done_a, done_b = [], []
            for s, e in zip(bounds, bounds[1:]):
                this = (key[s], i[s], j[s])
                if this != at:
                    if held and sum(map(len, held)) > 1:
                        made = close(held)
                        if made.num_rows:
                            done_a.append(made.column(0))
                            done_b.append(made.column(1))
                    held, at = [], this
                held.append(fp[s:e])
            if done_a:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(done_a), pa.concat_arrays(done_b)], ["a", "b"])
        if held:
            yield close(held)

    dealt = groups.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, max_bits: int = 4, list_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, representative struct<none, id, text_hash>) of every row.

    The representative is the smallest id of the component; among rows of one id, the
    one with the smallest hash of its text. ``fp`` holds the fingerprint's 64 bits.
    """
    rep = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("text_hash"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), fingerprint(text_col).alias("fp"))
    rows = saved(rows, "fingerprints")
    prints = saved(rows.groupBy("fp").agg(F.min(rep).alias("rep"), F.count("*").alias("copies")), "prints")
    roots = components(links(prints.select("fp"), max_bits=max_bits, list_rows=list_rows))
    named = prints.join(by_key(roots.withColumnRenamed("node", "fp")), "fp", "left")
    named = saved(named.select("fp", "rep", "copies", F.coalesce("root", "fp").alias("root")), "roots")
    best = saved(named.groupBy("root").agg(F.min("rep").alias("representative"), F.count("*").alias("prints")), "components")
    of_print = join_groups(named.select("fp", "copies", "root"), best, ["root"], "prints", named.count())
    of_print = of_print.select("fp", "copies", "representative")
    of_print = saved(of_print, "representatives")
    found = join_groups(rows, of_print, ["fp"], "copies", rows.count())
    return found.select(F.col("id").alias(id_col), "text_hash", "fp", "representative")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents that represent their components, with all their columns.

    Rows that repeat a representative exactly (id and text) all stay; exact
    deduplication is the step before.
    """
    found = near_duplicates(docs, **options)
    keep = found.where(F.col("representative.id").eqNullSafe(F.col("doc_id")) & (F.col("representative.text_hash") == F.col("text_hash")))
    names = fresh(docs, "kept_id", "kept_hash")
    keep = keep.select(F.col("doc_id").alias(names[0]), F.col("text_hash").alias(names[1])).distinct()
    on = docs["doc_id"].eqNullSafe(F.col(names[0])) & (F.xxhash64(docs["text"]) == F.col(names[1]))
    return docs.join(keep, on, "left_semi")
