"""Connected components of a distributed edge list, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalmap.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b longs); root is the smallest node it reaches.

    Each round every node points its neighbours at the smallest one (large star), then its smaller
    neighbours (small star). Both are an aggregate with map-side combine joined back, so a hub with
    many neighbours is never held in one group. Rounds grow with the log of the longest path; each is
    written to the shared folder, and only a count and a checksum come to the driver.
    """
    now = cut(_ordered(edges), "edges")
    seen = _checksum(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _ordered(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = cut(_ordered(small), "edges")
        last, seen = seen, _checksum(now)
        if last == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node to the smaller."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
