"""Approximate nearest neighbours by collision counting (operator 1).

Method: largest inner product becomes nearest distance by one more coordinate that gives
all vectors the length of the longest. Vectors are dealt at random to blocks; a block
keeps, for each of ``projections`` directions (random rotations), its vectors' projections
as a sorted array, and at every ``step`` places of it the set of the vectors before, as
bits. A query's windows are centred on its own projections and expand round by round
(virtual rehashing: the radius grows by ``growth``), outwards to whole steps; a vector
collides in a direction once it lies in the window. Collisions are added up for 64 vectors
at a time, as bits of carry-save adders. Vectors that collide in at least ``collisions`` of
all directions are verified by the inner product of the original vectors in double
precision, and the search in a block ends with the first radius at which ``budget`` vectors
for each of the k asked for were verified. All vectors over the threshold are verified, so
no list of candidates is capped. Queries are a stated set and visit every block.

Scale: a block holds about ``block_rows`` vectors, one task each; each vector is shuffled
once, each query once for each block, and a block returns k rows a query. With a fixed
share of all rows as queries the work is that share times the square of the rows.

Cases: vectors that are null, empty, zero or hold null or non-finite numbers take no part;
vectors of different lengths are never compared; of rows with one id the smallest vector
counts; ties go to the smaller id; with fewer than k candidates all are returned. Lengths
are taken relative to the largest number, so that very large and very small vectors take
part; an inner product beyond double precision is infinite, one that is undefined comes last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>, top, norm) of the vectors that take part: largest component, and length relative to it."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(F.forall("v", lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False))))
    rows = rows.withColumn("top", F.array_max(F.transform("v", F.abs))).where("top > 0")
    share = F.aggregate(F.transform("v", lambda x: F.try_divide(x, F.col("top"))), F.lit(0.0), lambda s, x: s + x * x)
    return rows.withColumn("norm", F.sqrt(share))


def counted(bits: np.ndarray) -> list[np.ndarray]:
    """The binary digits, lowest first, of how many of the sets ``bits[i]`` hold each element."""
    digits, level = [], bits
    while len(level):
        carried = []
        while len(level) > 2:
            k = len(level) // 3
            a, b, c = level[:k], level[k : 2 * k], level[2 * k : 3 * k]
            odd = a ^ b
            carried.append((a & b) | (odd & c))
            level = np.concatenate([odd ^ c, level[3 * k :]])
        if len(level) == 2:
            carried.append(level[:1] & level[1:])
            level = level[:1] ^ level[1:]
        digits.append(level[0])
        level = np.concatenate(carried) if carried else level[:0]
    return digits


def at_least(digits: list[np.ndarray], need: int) -> np.ndarray:
    """The set of elements whose number is ``need`` or more."""
    more, same = np.zeros_like(digits[0]), ~np.zeros_like(digits[0])
    for k in range(max(len(digits), need.bit_length()) - 1, -1, -1):
        digit = digits[k] if k < len(digits) else np.zeros_like(same)
        if need >> k & 1:
            same = same & digit
        else:
            more |= same & digit
            same = same & ~digit
    return more | same


class Block:
    """Sorted projections of some vectors, with the sets of those before each step."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, scale: float, longest: float, projections: int, seed: int, steps: int = 128):
        self.ids, self.vectors, self.n = ids, vectors, len(ids)
        self.unit = vectors / scale / longest
        rng, size = np.random.default_rng(seed), vectors.shape[1] + 1
        turns = [np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(-(-projections // size))]
        axes = np.concatenate(turns, axis=1)[:, :projections]
        self.axes = axes[:-1]
        extra = np.sqrt(np.maximum(1 - (self.unit**2).sum(axis=1), 0))
        along = (self.unit @ self.axes + extra[:, None] * axes[-1]).T
        order = np.argsort(along, axis=1, kind="stable")
        self.sorted = np.take_along_axis(along, order, axis=1)
        self.spread = float(along.std(axis=1).mean()) * math.sqrt(2) or 1.0
        self.step = max(1, -(-self.n // steps))
        marks, width = np.arange(0, self.n + self.step, self.step), -(-self.n // 64) * 8
        self.before = np.zeros((projections, len(marks), width), np.uint8)
        ranks = np.empty(self.n, np.int64)
        for places, sets in zip(order, self.before):
            ranks[places] = np.arange(self.n)
            bits = np.packbits(ranks < marks[:, None], axis=1, bitorder="little")
            sets[:, : bits.shape[1]] = bits
        self.before = self.before.view(np.uint64)

    def colliding(self, centres: np.ndarray, radius: float, need: int) -> np.ndarray:
        """(queries, words): the sets of vectors in at least ``need`` windows; ``centres`` are (directions, queries)."""
        low = np.stack([np.searchsorted(row, c - radius, "left") for row, c in zip(self.sorted, centres)]) // self.step
        high = -(-np.stack([np.searchsorted(row, c + radius, "right") for row, c in zip(self.sorted, centres)]) // self.step)
        every = np.arange(len(centres))[:, None]
        return at_least(counted(self.before[every, high] ^ self.before[every, low]), need)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, radius: float, growth: float, collisions: float, budget: int, batch: int = 32):
        """For each query its number, and the row numbers and scores of its k best verified vectors.

        More vectors pass the threshold with every radius, so a batch starts from a radius
        at which a part of the batch before it ended.
        """
        need, enough, start = math.ceil(collisions * len(self.sorted)), min(self.n, budget * k + 1), 0
        # A query's own length does not change its order of vectors.
        unit = queries / np.abs(queries).max(axis=1, keepdims=True)
        unit = unit / np.sqrt((unit**2).sum(axis=1, keepdims=True))
        centres = (unit @ self.axes).T
        for at in range(0, len(queries), batch):
            left, step, ended = np.arange(at, min(at + batch, len(queries))), start, []
            while len(left):
                found = self.colliding(centres[:, left], radius * self.spread * growth**step, need)
                done = np.bitwise_count(found).sum(axis=1) >= enough
                for q, bits in zip(left[done], found[done]):
                    yield q, *self.verified(bits, query_ids[q], queries[q], unit[q], k)
                ended += [step] * int(done.sum())
                left, step = left[~done], step + 1
            start = int(np.quantile(ended, 0.3))

    def verified(self, bits: np.ndarray, query_id: int, query: np.ndarray, unit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        found = np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little", count=self.n))
        found = found[self.ids[found] != query_id]
        if len(found) > k:
            # One product ranks them; the best, and all that rounding could confuse with
            # them, are summed again in a fixed order.
            rough = self.unit[found] @ unit
            found = found[rough >= np.partition(rough, -k)[-k] - 1e-12]
        with np.errstate(over="ignore", invalid="ignore"):
            scores = (self.vectors[found] * query).sum(axis=1)
        best = np.lexsort((self.ids[found], -scores))[:k]
        return found[best], scores[best]


def search(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 20,
    projections: int = 64,
    radius: float = 0.5,
    growth: float = 1.08,
    collisions: float = 0.8,
    budget: int = 8,
    block_rows: int = 4096,
    seed: int = 7,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, id and score of the k nearest found for each row where ``is_query``.

    ``is_query`` is a condition on the column ``id``.
    """
    rows = saved(usable(vectors, id_col, vector_col), "vectors")
    n, scale = rows.agg(F.count("*"), F.coalesce(F.max("top"), F.lit(1.0))).first()
    (longest,) = rows.agg(F.coalesce(F.max(F.col("norm") * (F.col("top") / scale)), F.lit(1.0))).first()
    blocks = max(1, math.ceil(n / block_rows))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    data = rows.select("id", "v", own.alias("block"), F.lit(False).alias("query"))
    asked = rows.where(is_query).select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("query"))
    dealt = data.unionByName(asked).withColumn("size", F.size("v"))
    dealt = dealt.repartitionById(blocks, F.col("block")).sortWithinPartitions("size", "query", "id", "v").select("size", "query", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        block, size, last = None, None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, kinds, ids = (part.column(c).to_numpy(zero_copy_only=False) for c in range(3))
                flat, ends = part.column(3).flatten().to_numpy(), np.cumsum(sizes)
                cuts = np.flatnonzero((np.diff(sizes) != 0) | (np.diff(kinds.astype(int)) != 0)) + 1
                for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
                    v = flat[ends[s] - sizes[s] : ends[e - 1]].reshape(e - s, sizes[s])
                    if sizes[s] != size:
                        held, block, size, last = [], None, sizes[s], None
                    if not kinds[s]:
                        held.append((ids[s:e], v))
                        continue
                    if block is None and held:
                        all_ids, all_v = (np.concatenate(x) for x in zip(*held))
                        first = np.concatenate([[True], np.diff(all_ids) != 0])
                        block = Block(all_ids[first], all_v[first], scale, longest, projections, seed)
                    if block is None:
                        continue
                    fresh = np.concatenate([[ids[s] != last], np.diff(ids[s:e]) != 0])
                    last = ids[e - 1]
                    asked_ids, asked_v = ids[s:e][fresh], v[fresh]
                    found = list(block.search(asked_ids, asked_v, k, radius, growth, collisions, budget))
                    if found:
                        repeats = np.repeat(asked_ids[[q for q, *_ in found]], [len(f) for _, f, _ in found])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(repeats), pa.array(np.concatenate([block.ids[f] for _, f, _ in found])), pa.array(np.concatenate([s for *_, s in found]))],
                            ["query_id", "id", "score"],
                        )

    best = dealt.mapInArrow(run, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "id"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
