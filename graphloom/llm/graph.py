"""Connected components of links, as a distributed union-find on tables (star contraction)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

ROUNDS_AT_MOST = 60


def components(links: DataFrame, space: Workspace) -> DataFrame:
    """node, root: of each node on any link (columns a, b; nodes with an order) the smallest node of its component.

    Each round first hooks every larger neighbour of a node to the smallest node of its neighbourhood (large star),
    then hooks the smaller ones (small star); it ends when a round changes
    nothing (told by count and two hashes of the links), after about log2 of the longest
    chain. A node with very many neighbours is one key of a grouping with partial aggregation and the
    side of a plain join that Spark can split. Each round's links are written and read again.
    """
    pairs = links.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct()
    pairs = space.keep(pairs, "links")
    told = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u")), F.bit_xor(F.xxhash64(F.lit("second"), "v", "u"))).first())
    before = told(pairs)
    for _ in range(ROUNDS_AT_MOST if before[0] else 0):
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every node with smaller neighbours hooks them, and itself, to the smallest
        large = space.keep(large.where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(low, F.col("u") == F.col("w"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("w").alias("u"), F.col("m").alias("v")))
        pairs = space.keep(small.where("u <> v").select("v", "u").distinct(), "small")
        now = told(pairs)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return pairs.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").union(pairs.select("v", F.col("v").alias("root")).distinct())
