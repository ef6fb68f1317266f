"""Helpers shared by the operators: slices of texts, hash folds, joins of hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import saved, shared_dir  # noqa: F401

#: Spark's own bound on the bytes of an Arrow batch.
DEFAULT_BYTES = "67108864b"
#: Texts that a task measures together, in bytes.
SLICE_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id is in fold 0."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string")) % modulus, F.lit(0)).cast("int")


def slices(sizes: Iterable[int], rows: int, most: int) -> Iterator[slice]:
    """Ranges of at most ``rows`` rows and ``most`` bytes together; a larger row is alone. One empty range for no rows."""
    start = total = end = 0
    for end, size in enumerate(sizes):
        if end > start and (end - start == rows or total + size > most):
            yield slice(start, end)
            start, total = end, 0
        total += size
        end += 1
    yield slice(start, end)


def text_bytes(texts: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def in_slices(batches: Iterable[pa.RecordBatch], rows: int = 256, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that one step never holds the Python objects of a whole batch: ``rows`` rows and ``most`` bytes of text, or one row."""
    for batch in batches:
        texts = [text_bytes(c) for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
        sizes = map(sum, zip(*texts)) if texts else [0] * batch.num_rows
        for s in slices(sizes, rows, most):
            if s.stop > s.start:
                yield batch.slice(s.start, s.stop - s.start)


def packed(ids: Iterable[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return np.fromiter(ids, "<u4").tobytes()


class Known(dict):
    """What ``make`` gives for a key, remembered; ``older`` is the generation before."""

    def __init__(self, make: Callable[[str], bytes], older: dict):
        super().__init__()
        self.make, self.older = make, older

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        self[key] = value = self.make(key) if value is None else value
        return value


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int, hot_rows: int = 256) -> DataFrame:
    """``rows`` inner joined to ``groups`` (one row for each key) on columns without nulls.

    ``size`` is the column of ``groups`` with the number of rows of each key, ``total`` the
    number of all rows. Keys with more than ``hot_rows`` rows, and more than a 4096th of all,
    are hot. There can be no more than 4096 of them, so they are broadcast and their rows
    stay where they are, however many one key has; all others are dealt by the key, on both
    sides (``by_key``).
    """
    bound = max(hot_rows, total // 4096)
    hot = groups.where(F.col(size) > bound)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(cold.join(by_key(groups.where(F.col(size) <= bound)), on))


def by_key(side: DataFrame) -> DataFrame:
    """``side`` as one that a join deals by the key, not broadcast.

    Spark takes the size of exploded or aggregated rows from the files below them: postings count
    as a small part of what they are, and millions of rows would be collected on the driver.
    """
    return side.hint("merge")


def join_small(rows: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", most: int = 4_000_000) -> DataFrame:
    """``rows`` joined to narrow rows, which are broadcast where a count shows at most ``most`` of them, else shuffled."""
    small = saved(small, "join-side")
    return rows.join(F.broadcast(small) if small.count() <= most else small, on, how)


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of at most ``size`` bytes in this session, unless the session has a bound of its own.

    Spark counts rows only, and 10,000 whole texts fill an executor's memory outside its
    heap. Queries and pipeline stages call this; operators leave the session as it is.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == DEFAULT_BYTES:
        spark.conf.set(key, size)


def text_function(run: Callable[[pd.Series], pa.Array], kind: T.DataType, text_col: str, rows: int = 128) -> Column:
    """``run`` over a text column; a task makes Python strings of ``rows`` texts, or ``SLICE_BYTES`` of text, at a time only."""

    @F.arrow_udf(kind)
    def sliced(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([run(texts[s].to_pandas()) for s in slices(text_bytes(texts), rows, SLICE_BYTES)])

    return sliced(F.col(text_col))


def known_labels(labels: DataFrame, label: str, held_out: Column) -> DataFrame:
    """(doc_id, label) of all ids outside ``held_out`` with a label 0 or 1.

    Rows with null ids or labels take no part; of contradicting labels of one id the larger holds.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out)
    return known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def labelled_sample(labels: DataFrame, docs: DataFrame, label: str, held_out: Column, per_class: int) -> DataFrame:
    """(doc_id, text, label, weight) of at most ``per_class`` labelled ids of each class 0 and 1.

    The ids are chosen in the order of a hash of doc_id, so the choice does not depend
    on partitioning. The chosen ids are few (2 * per_class), so their join to the
    documents is a broadcast of proven size and no text is shuffled. ``weight`` is the
    number of all labelled ids of the class that have a document, for each chosen one.
    Of several rows of one id the sample has one, that with the smallest hash of its text.
    """
    known = known_labels(labels, label, held_out).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    known = saved(known, f"{label}-labels")
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    ids = [
        known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        .withColumn("weight", F.lit(max(1.0, sizes.get(c, 0) / per_class)))
        for c in (0, 1)
    ]
    chosen = ids[0].unionByName(ids[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id", "label", "weight").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.select("doc_id", "text", "label", "weight")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before those that ``df`` already has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
