"""Exact deduplication screened by binary-fuse filters (operator 9).

Method: the rows are an immutable snapshot and an incoming batch. Each snapshot bucket
(a range of hashed digests) gets a static 3-wise binary-fuse filter of 8-bit
fingerprints, about 9 bits a text. Incoming digests, grouped by themselves first, are
screened by the filter of their bucket: a negative is new for certain and never meets the
snapshot; a positive joins its exact bucket, where the bytes are checked.

Groups are formed by SHA-256 and length of the normalised text, without a shuffle of
texts. Then the bytes themselves are compared for every group of two rows or more: the
texts are read again and screened by a bitmap of these groups' digests, at most
``2 ** 20`` words of 64 bits, so its broadcast is bounded; each task keeps one copy of each
different text that passes, and only these are shuffled. The plan is the same at every
size: with more groups than bits the bitmap lets more texts of single rows pass, which costs
shuffle and changes no result. Different texts under one digest and length are groups of
their own. ``unique`` reads and shuffles texts once more, to meet the rows that stay. A
group of copies is pre-aggregated to one row in each task, so a group with a third of all
rows is no load for any task.

Cases: a null text counts as empty; texts of white space only are equal to it; of equal
texts the longest original stays, then the smallest id (null ids last), of rows with one id
and length any one; repeated rows form one group; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, fresh, join_groups, saved

SPACES = " \t\n\x0b\x0c\r"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing of keys under a seed."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64(seed) * GOLDEN
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class BinaryFuseFilter:
    """Static filter of distinct 64-bit keys: no false negatives, about 1/256 positives else."""

    def __init__(self, seed: int, segment: int, segments: int, cells: np.ndarray):
        self.seed, self.segment, self.segments, self.cells = seed, segment, segments, cells

    @staticmethod
    def slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        """Three cells in neighbouring segments, (3, n)."""
        first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        start = first * np.uint64(segment)
        inside = [h & mask, (h >> np.uint64(18)) & mask, (h >> np.uint64(36)) & mask]
        return np.stack([start + np.uint64(k * segment) + inside[k] for k in range(3)]).astype(np.int64)

    @staticmethod
    def prints(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 4 if n < 2 else min(1 << 18, 1 << int(math.log(n) / math.log(3.33) + 2.25))
        factor = 2.0 if n < 2 else max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        for seed in range(1, 200):
            segments = max(1, math.ceil(n * factor * (1 + 0.02 * (seed - 1)) / segment) - 2)
            h = mix(keys, seed)
            slots = cls.slots(h, segment, segments)
            order = cls._peel(slots, (segments + 2) * segment)
            if order is not None:
                cells = np.zeros((segments + 2) * segment, np.uint8)
                prints = cls.prints(h)
                for rows, own in reversed(order):
                    s = slots[:, rows]
                    cells[own] = 0
                    cells[own] = prints[rows] ^ cells[s[0]] ^ cells[s[1]] ^ cells[s[2]]
                return cls(seed, segment, segments, cells)
        raise RuntimeError("no seed gave a filter")

    @staticmethod
    def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, the cell that each has alone); None if a core remains."""
        n = slots.shape[1]
        degree = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)  # xor of the keys at each cell
        for k in range(3):
            np.bitwise_xor.at(owner, slots[k], np.arange(n))
        order, left = [], n
        alone = np.flatnonzero(degree == 1)
        while len(alone):
            rows, first = np.unique(owner[alone], return_index=True)
            order.append((rows, alone[first]))
            left -= len(rows)
            touched = slots[:, rows].ravel()
            np.subtract.at(degree, touched, 1)
            np.bitwise_xor.at(owner, touched, np.tile(rows, 3))
            touched = np.unique(touched)
            alone = touched[degree[touched] == 1]
        return order if left == 0 else None

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        h = mix(keys.astype(np.uint64), self.seed)
        s = self.slots(h, self.segment, self.segments)
        return self.prints(h) == self.cells[s[0]] ^ self.cells[s[1]] ^ self.cells[s[2]]


def sha256(normal: Column) -> Column:
    return F.unhex(F.sha2(F.encode(normal, "utf-8"), 256))


def normalised(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(id, n_chars, normal, sha binary, n_bytes, key long) of each row: its normalised text and that text's digest."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    normal = F.translate(text, SPACES, "")
    rows = docs.select(F.col(id_col).alias("id"), F.length(text).alias("n_chars"), normal.alias("normal"))
    return rows.select("*", digest(F.col("normal")).alias("sha"), F.octet_length("normal").alias("n_bytes")).withColumn("key", F.xxhash64("sha"))


def screened_texts(texts: DataFrame, groups: DataFrame, bits: int = 26) -> DataFrame:
    """The rows of ``texts(key, …)`` whose digest may be that of one of ``groups(key)``; none of theirs is lost.

    A digest is a place in ``2 ** bits`` bits; the words of 64 bits in which any is set are broadcast.
    """
    place = F.pmod("key", F.lit(1 << bits))
    word, bit = F.shiftright(place, 6), F.expr(f"shiftleft(1L, cast(pmod(key, {1 << bits}) & 63 as int))")
    held = saved(groups.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("mask")), "digest-bitmap")
    met = texts.withColumn("word", word).join(F.broadcast(held), "word")
    return met.where(F.col("mask").bitwiseAND(bit) != 0).drop("word", "mask")


def clashes(texts: DataFrame, groups: DataFrame, bits: int = 26) -> DataFrame:
    """(sha, n_bytes) under which ``texts(normal, sha, n_bytes, key)`` of ``groups(key)`` are not all the same bytes."""
    same = ["sha", "n_bytes"]
    different = screened_texts(texts, groups, bits).select(*same, "normal").distinct()
    return different.groupBy(*same).count().where("count > 1").select(*same)


def best_row() -> Column:
    """What orders the rows of a group: the longest, then the smallest id, null ids last."""
    return F.struct((-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))


def regrouped(rows: DataFrame, groups: DataFrame, texts: DataFrame, clashing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` and ``groups`` with those of ``clashing`` digests grouped by their texts.

    A number for each different text is put behind the digest. Rows of such digests are read
    and numbered anew from ``texts``; their texts, and no others, are shuffled.
    """
    same = ["sha", "n_bytes"]
    own = saved(texts.join(clashing, same, "left_semi").withColumn("row", F.monotonically_increasing_id()), "clashing-rows")
    parts = own.groupBy(*same, "normal").agg(F.min(best_row()).alias("keep"), F.count("*").alias("group_size"))
    nth = F.row_number().over(Window.partitionBy(*same).orderBy("normal"))
    parts = saved(parts.withColumn("tag", F.concat("sha", F.encode(nth.cast("string"), "utf-8"))), "clashing-groups")
    tagged = join_groups(own, parts.select(*same, "normal", "tag", "group_size"), [*same, "normal"], "group_size", own.count())
    rows = rows.join(clashing, same, "left_anti").unionByName(tagged.select("id", "row", F.col("tag").alias("sha"), "n_bytes"))
    groups = groups.join(clashing, same, "left_anti")
    return rows, groups.unionByName(parts.select(F.col("tag").alias("sha"), "n_bytes", "keep", "group_size"))


def fuse_filters(groups: DataFrame) -> DataFrame:
    """(bucket, seed, segment, segments, cells): one filter for each bucket of ``groups(bucket, key)``."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = BinaryFuseFilter.build(pdf["key"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "cells": [f.cells.tobytes()]})

    return groups.select("bucket", "key").groupBy("bucket").applyInPandas(build, "bucket long, seed int, segment int, segments int, cells binary")


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """``incoming(bucket, key, …)`` with a boolean ``maybe``: false is certain to be new."""

    def test(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        rows = rows.copy()
        rows["maybe"] = False
        if len(held) and len(rows):
            f = held.iloc[0]
            fuse = BinaryFuseFilter(int(f["seed"]), int(f["segment"]), int(f["segments"]), np.frombuffer(f["cells"], np.uint8))
            rows["maybe"] = fuse.may_hold(rows["key"].to_numpy(np.int64).view(np.uint64))
        return rows

    keyed = incoming.select("bucket", "key", "sha", "n_bytes")
    schema = "bucket long, key long, sha binary, n_bytes int, maybe boolean"
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(test, schema)


def exact_groups(
    docs: DataFrame,
    *,
    in_snapshot: Column | None = None,
    bucket_keys: int = 65_536,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
) -> tuple[DataFrame, DataFrame, int, DataFrame | None]:
    """Rows (id, row, sha, n_bytes), groups (sha, n_bytes, keep struct<…, id, row>, group_size), number of rows, clashing digests.

    ``in_snapshot`` says which rows are the snapshot; by default half of the ids. The
    result does not depend on it, only which rows are screened does. Clashing digests
    (sha, n_bytes) are those of several texts, whose ``sha`` here is longer; None if there are none.
    """
    texts = normalised(docs, id_col, text_col, digest)
    rows = texts.drop("normal")
    if in_snapshot is None:
        in_snapshot = fold("id", 2) == 0
    # Numbers of rows are written with them, so that they stay the same when a task is run again.
    rows = saved(rows.withColumn("old", in_snapshot).withColumn("row", F.monotonically_increasing_id()), "digests")
    total = rows.count()
    buckets = max(1, math.ceil(total / bucket_keys))
    one = rows.groupBy("old", "key", "sha", "n_bytes").agg(F.min(best_row()).alias("keep"), F.count("*").alias("n"))
    one = saved(one.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("long")), "digest-groups")
    snapshot, batch = one.where("old"), one.where(~F.col("old"))
    screened = screen(batch, fuse_filters(snapshot)).where("maybe").select("key", "sha", "n_bytes")
    # In the exact bucket what the filter let through in error stays apart.
    held = snapshot.select("key", "sha", "n_bytes", F.col("keep").alias("old_keep"), F.col("n").alias("old_n"))
    checked = screened.join(held, ["key", "sha", "n_bytes"])
    same = ["sha", "n_bytes"]
    known = batch.join(checked.drop("key"), same, "left")
    of_batch = known.select(*same, F.least("keep", "old_keep").alias("keep"), (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("group_size"), F.col("old_n").isNotNull().alias("merged"))
    merged = of_batch.where("merged").select(*same)
    of_snapshot = snapshot.join(merged, same, "left_anti").select(*same, "keep", F.col("n").alias("group_size"))
    groups = saved(of_batch.drop("merged").unionByName(of_snapshot), "exact-groups")
    rows = rows.select("id", "row", *same)
    clashing = saved(clashes(texts, groups.where("group_size > 1").select(F.xxhash64("sha").alias("key"))), "clashing-digests")
    if clashing.isEmpty():
        return rows, groups, total, None
    return *regrouped(rows, groups, texts, clashing), total, clashing


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: the row that stays for it, its group's size and its digest."""
    rows, groups, total, _ = exact_groups(docs, **options)
    found = join_groups(rows, groups, ["sha", "n_bytes"], "group_size", total)
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("keep.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("keep.row") == F.col("row")).alias("kept"),
        F.lower(F.hex(F.substring("sha", 1, 32))).alias("text_sha256"),
    )


def unique(docs: DataFrame, *, hot_rows: int = 256, digest: Callable[[Column], Column] = sha256, **options) -> DataFrame:
    """The rows that stay, with all their columns; of rows with one id and text, any one.

    Documents meet the rows that stay by id, digest and length together, so the copies of
    one text are dealt over all tasks. Rows that repeat an id and text are hot where they are
    more than ``hot_rows`` and a 4096th of all: there can be no more than 4096 such keys, which
    are broadcast, and each task keeps one row of each before any are dealt. Documents of
    clashing digests, if there are any, are grouped by their texts.
    """
    rows, groups, total, clashing = exact_groups(docs, digest=digest, **options)
    keys = fresh(docs, "id_key", "sha_key", "n_key", "normal_key", "bytes_key")
    nth = fresh(docs, "nth")[0]

    def key_of(doc_id: Column) -> Column:
        return F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("")).alias(keys[0])

    stay = groups.select(key_of(F.col("keep.id")), F.col("sha").alias(keys[1]), (-F.col("keep.less")).alias(keys[2]))
    text = F.coalesce(docs["text"], F.lit(""))
    normal = F.translate(text, SPACES, "")
    length = F.length(text).alias(keys[2])
    keyed = docs.select(*(docs[c] for c in docs.columns), key_of(docs["doc_id"]), digest(normal).alias(keys[1]), length)
    apart = None
    if clashing is not None:
        clashing = clashing.toDF(keys[1], keys[4])
        by_bytes = [keys[1], keys[4]]
        keyed = keyed.withColumns({keys[3]: F.translate(F.coalesce("text", F.lit("")), SPACES, "")}).withColumn(keys[4], F.octet_length(keys[3]))
        best = F.struct(-F.col(keys[2]), F.col("doc_id").isNull(), F.col("doc_id"))
        apart = keyed.join(clashing, by_bytes, "left_semi").groupBy(keys[3]).agg(F.min_by(F.struct(*docs.columns), best).alias(nth))
        keyed = keyed.join(clashing, by_bytes, "left_anti").drop(*keys[3:])
    keys = keys[:3]
    same = keys[:2]
    whole = lambda df: df.select(F.col(nth).alias("row")).select(*(F.col(f"row.{c}") for c in docs.columns))
    often = rows.groupBy(key_of(F.col("id")), F.col("sha").alias(keys[1])).count().where(F.col("count") > max(hot_rows, total // 4096))
    often = saved(often.select(*same), "exact-repeats")
    hot = keyed.join(F.broadcast(often), same, "left_semi").groupBy(*keys).agg(F.first(F.struct(*docs.columns)).alias(nth))
    hot = hot.join(stay, keys, "left_semi")
    cold = keyed.join(F.broadcast(often), same, "left_anti").join(stay, keys, "left_semi")
    if often.isEmpty():
        kept = one_of_each_key(keyed.join(stay, keys, "left_semi"), keys, nth).select(*docs.columns)
    else:
        kept = one_of_each_key(cold, keys, nth).select(*docs.columns).unionByName(whole(hot))
    return kept if apart is None else kept.unionByName(whole(apart))


def one_of_each_key(rows: DataFrame, keys: list[str], nth: str) -> DataFrame:
    """One row of each key, of rows that a join has dealt by ``keys``: the ranking needs no shuffle of its own."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(keys[2]))
    return rows.withColumn(nth, first).where(F.col(nth) == 1)
