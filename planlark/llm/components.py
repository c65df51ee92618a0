"""Connected components of a link table by alternating large and small stars.

Each round joins every node to the least node around it; the links stay in tables, and only their number and a check
sum come to the driver. Rounds grow with the logarithm of the longest chain.

Skew: the centre of a star may have a third of all nodes around it. Each node's least neighbour comes from a partial
aggregate that is written, so the join back is a plain sort-merge join whose large partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlark.llm.common import written


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """links: (a long, b long). Returns (node, component) for each node with a link; component is its smallest node."""

    def least(both: DataFrame) -> DataFrame:
        mins = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        return both.join(mins.hint("merge"), "u")

    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        met = least(down)
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
