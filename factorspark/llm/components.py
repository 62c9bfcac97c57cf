"""Connected components of an edge table by alternating large and small stars.

Each round is a few aggregates and joins, and its edges are written once to the shared folder;
the number of rounds grows with the logarithm of the longest chain. A hub meets itself only in
aggregates that combine before their shuffle and in joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.runtime import materialise


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """(node, root) of every node of the edges (a, b); the root is the smallest node reachable.

    Loops, repeated and reversed edges do no harm; edges with a null end are ignored."""
    links = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    before = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.count(F.when(F.col("u") < F.col("v"), 1))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), label)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = materialise(small.where("u <> v").distinct(), label)
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
