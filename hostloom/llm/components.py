"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: a, b long. Returns id, label for each vertex that has an edge to another one; label is the
    smallest id of its component. The number of rounds grows with the logarithm of the longest path, and
    a hub is met in an equi-join with one row a vertex, never gathered.
    """
    edges = scratch.cut(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written before the join, so that the rows of a hub meet it in a shuffle whose hot keys are split
        least = lows = scratch.cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.cut(large)
        least = scratch.cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = scratch.cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for old in (edges, large, lows, least):
            scratch.forget(old)
        edges = after
        if now == state or not now[0]:
            break
        state = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()
    )
