"""Connected components by alternating large and small stars, each a join and an aggregation.

Results in odd cases: edges from a node to itself and edges with a null end are left out; repeated edges and edges in both directions count
once; without edges there are no rows; a hub with very many edges is split by Spark's skew handling, as no step gathers its neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize


def _settled(stars: DataFrame) -> bool:
    """Whether every node points to one root, and roots point to nothing."""
    ends = stars.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(stars.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR (out = 1 AND into = 1)").limit(1).count() == 0


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b) -> (node, root) for every node with an edge; root is the component's smallest node."""
    stars = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(stars):
            break
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # now every edge goes from u to a smaller v
        large = materialize(large, "large-stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        before, stars = stars, materialize(small, "small-stars")
        discard(before)
        discard(large)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
