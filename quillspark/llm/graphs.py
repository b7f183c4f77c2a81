"""Connected components as DataFrame operations: large-star and small-star steps over an edge table, no driver-side links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of ``edges`` (x, y): root is the smallest node that can be reached.

    Each round hangs every neighbour on the smallest one (first the larger neighbours, then the smaller ones); the rows never
    outgrow the edges, and a table is written after each round. It ends when a round changes nothing.
    """
    now = written(edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x != y").distinct(), "edges")
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x != y").distinct()
        down = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(down, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x != y").unionByName(down.select("x", F.col("m").alias("y"))).distinct()
        new = written(small, "edges")
        same = new.count() == now.count() and new.join(now, ["x", "y"], "left_anti").isEmpty()
        discard(now)
        now = new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
