"""Connected components of an edge table by alternating stars; nothing but a count comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.llm.shared import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component: each node of ``edges`` (a, b: longs) with the least node it is connected with.

    Large-star links each node's larger neighbours to the least of its neighbourhood,
    small-star its smaller ones and itself; the rounds go on until only stars around the least
    nodes are left, O(log n) of them.  Each round is written to the shared folder.  No edges, no rows.
    """
    stars = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = stars.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if state == before or not state["n"]:
            break
        before = state
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        stars = cut(small.select("e.u", "e.v").where("u <> v").distinct())
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
