"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, saved

#: A broadcast of at most two nodes for each of so many links, two numbers a node.
FEW_LINKS = 100_000


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; root is the smallest node reachable.

    Each round links every node's larger neighbours to its smallest one, then its smaller
    neighbours likewise, until nothing changes; the number of rounds is logarithmic in
    the length of the longest chain. All rounds are joins and partial aggregates of the
    link table, in which Spark splits the partition of a node with very many links (adaptive
    skew joins: the other side has one row a node); only two numbers come to the driver. Null ends and self-links are ignored.
    """
    links = links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    links = saved(links.where("low < high").distinct(), "links")

    def measure(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())

    before = measure(links)
    if not before[0]:
        return links.select(F.col("high").alias("node"), F.col("low").alias("root"))
    for _ in range(max_rounds):
        # Few links are counted, so their nodes are broadcast and the rows of a node with many links stay where they are.
        meet = F.broadcast if before[0] <= FEW_LINKS else by_key
        both = links.select(F.col("low").alias("u"), F.col("high").alias("v")).union(links.select("high", "low"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(meet(least), "u").select(F.col("m").alias("low"), F.col("v").alias("high"))
        large = large.where("low < high").distinct()
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        joined = large.join(meet(least), "high")
        small = joined.select(F.col("m").alias("low"), F.col("low").alias("high")).union(joined.select("m", "high"))
        links = saved(small.where("low < high").distinct(), "links")
        after = measure(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("high").alias("node"), F.col("low").alias("root"))
