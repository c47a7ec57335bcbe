"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.llm.common import discard, scratch, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node that has an edge; root is the least node of its component.

    Edges of a hub are never gathered: the least neighbour comes from an aggregate with map-side combining, and a join, which Spark splits where a hub
    is hot, hands it out. Rounds grow with the logarithm of the node count; each is written to the scratch folder, so a lost executor repeats one round.
    Loops are dropped, repeated edges count once, null ends are dropped, and no edges give no rows.
    """
    spark = edges.sparkSession
    now = edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    place = scratch(spark)
    now, seen = written(now, place), None
    while True:
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(xxhash64(v, u) % 1000003)")).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).unionByName(low.select("u", F.col("m").alias("v")))
        seen, old, place = state, place, scratch(spark)
        now = written(small.distinct(), place)
        discard(spark, old)
