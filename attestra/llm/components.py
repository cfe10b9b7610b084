"""Connected components as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import discard, materialize


def lowest(edges: DataFrame) -> DataFrame:
    """u, m: each end of an edge with the lowest of itself and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). Returns u, root: every node that isn't the lowest of its component, with the lowest. The tables of a round go once the next is written.

    Alternating large and small stars (Kiveris et al. 2014) until nothing moves: each round hooks all
    neighbours of a node onto the lowest, first those above it, then those below. Nothing is gathered by node.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large-star")
        least = lowest(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges, used = materialize(small, "small-star"), edges
        discard(large, used)
        before, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if state == before:
            return edges.select("u", F.col("v").alias("root"))
