"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstflow.llm.common import written


def _toward(pairs: DataFrame) -> DataFrame:
    """Each node's least neighbour, itself included, beside each of its pairs."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (u, v); root is the least node of its component.

    Large-star and small-star in turn, until nothing changes: a number of
    rounds that grows with the logarithm of the number of edges. Each round's
    edges are written to the shared folder. A node's least neighbour is found
    by an aggregate that combines before its exchange, and the pairs of a hub
    are joined to one row, which the optimiser may split.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        size = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(size) == before or not size[0]:
            break
        before = tuple(size)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _toward(large)
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = written(moved.filter("u <> v").distinct(), "edges")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
