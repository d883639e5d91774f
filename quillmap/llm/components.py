"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.llm import common


def components(edges: DataFrame, *, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root): every node of an edge with the smallest node of its component.

    Each round leaves at most as many edges as before and is checkpointed; the
    number of rounds grows with the logarithm of the components' diameter. The
    smallest neighbours are written too before they are joined: a join of two
    plain shuffles is one whose hot nodes Spark can split.
    """
    common.use_checkpoints(edges.sparkSession)
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct().checkpoint()
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    mark = None
    for _ in range(rounds):
        # large stars: the larger neighbours of a node hang on its smallest
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).checkpoint()
        large = both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small stars: a node and its smaller neighbours hang on the smallest
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        down = down.checkpoint()
        least = down.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        small = down.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = small.checkpoint()
        # a sum of hashes over the edges tells whether they are the same as before
        last, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            break
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
