"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bunkerline.llm.common import store


def _star(directed: DataFrame, keep) -> DataFrame:
    """Link the chosen neighbours of every node to its least neighbour, the node itself included."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return directed.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); the root is the component's least node.

    Each round is two aggregations with map-side combining and two joins on a node, whatever the number of a node's
    edges; the number of rounds grows with the logarithm of the number of nodes. Loops and repeated edges do no harm, edges with a null end are left out.
    """
    state = store(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        mark = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or not mark["n"]:
            break
        before = mark
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, F.col("v") > F.col("u")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        state = store(small.select("e.*").where("u <> v").distinct())
    rooted = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return rooted.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
