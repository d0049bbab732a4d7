"""Connected components of links, by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelflens.session import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (a, b); the component is its smallest node.

    Each round joins every node's neighbours to its smallest neighbour, once upwards and once downwards, until nothing
    changes: a number of rounds that grows with the logarithm of the size. A hub is a key of joins and of pre-aggregated
    minima, never one group in memory. Each round's edges are written to the shared folder, which cuts the lineage.
    Null ends and loops are dropped; without edges the result is empty.
    """
    now = materialize(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = _state(now)
    while before[0]:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written first, so that adaptive execution can split the join where a hub has very many edges
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = (both.join(low, "a").where(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b"))
        large = materialize(large, name)
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), name)
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
