"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Workspace


def connected_components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """``node, label`` for each node of ``edges(a, b)``; label is the smallest node.

    Every step is a partial aggregate and a join on the node, so a hub of many
    edges is split like any skewed key; each step's edges are a written table.
    """
    now = ws.table(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    step, before = 0, None
    while True:
        print_ = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if print_ == before or print_[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = print_
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = ws.table(large, f"{name}-{step}l")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = ws.table(small, f"{name}-{step + 1}")
        ws.drop(f"{name}-{step}", f"{name}-{step}l")
        step += 1
