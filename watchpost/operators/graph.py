"""Connected components in rounds that grow with the logarithm of the longest path."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def connected(links: DataFrame, a: str = "src", b: str = "dst", most_rounds: int = 64) -> DataFrame:
    """node and root (the smallest node reachable) of every node in ``links``.

    Rounds of two steps: the larger neighbours of a node move to the smallest node around it
    (large star), then a node's smaller neighbours and itself move to the smallest of them
    (small star).  A node's smallest neighbour comes from partial minima, so a hub costs one
    row a task; the links of a hub are joined back by (node, part of the neighbour), so no
    task meets all of them.  Every round is written, and ends when all links point at roots.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    nodes = ends.select(F.col("a").alias("node")).unionByName(ends.select(F.col("b").alias("node"))).distinct()
    stars = cut(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    for _ in range(most_rounds):
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _to_lowest(both, lambda u, v: v > u).select(F.col("low").alias("a"), F.col("v").alias("b")).distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        small = _to_lowest(down, lambda u, v: F.lit(True))
        moved = small.select(F.col("low").alias("a"), F.col("v").alias("b")).unionByName(small.select(F.col("low").alias("a"), F.col("u").alias("b")))
        stars = cut(moved.where("a < b").distinct())
        several = stars.groupBy("b").count().where("count > 1").select(F.lit(1))
        inner = stars.select(F.col("a").alias("x")).join(stars.select(F.col("b").alias("x")), "x", "left_semi").select(F.lit(1))
        if several.unionByName(inner).isEmpty():
            return nodes.join(stars.select(F.col("b").alias("node"), F.col("a").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _to_lowest(links: DataFrame, wanted, parts: int = 32) -> DataFrame:
    """u, v of the wanted links with low: the smallest of u and its neighbours."""
    dealt = links.withColumn("_p", F.pmod(F.xxhash64("v"), F.lit(parts)).cast("int"))
    each = dealt.groupBy("u", "_p").agg(F.min("v").alias("_m"))  # at most ``parts`` rows a node
    low = each.groupBy("u").agg(F.least("u", F.min("_m")).alias("low"), F.collect_set("_p").alias("_ps"))
    spread = low.select("u", "low", F.explode("_ps").alias("_p"))
    return dealt.where(wanted(F.col("u"), F.col("v"))).join(spread, ["u", "_p"]).select("u", "v", "low")
