"""Connected components by alternating large-star and small-star steps over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldframe.llm.work import Work


def components(edges: DataFrame, work: Work, tag: str) -> DataFrame:
    """Edges (a, b) of integer nodes to one row (node, component) for each node in them; the component is its smallest node.

    Each round ties every node to the smallest neighbour (first the larger neighbours, then the smaller), as two joins on the node
    with the minimum added up before the shuffle. A round's edges are written; the loop ends when they stay the same, which takes
    a logarithmic number of rounds. Loops and repeated edges do no harm.
    """
    one_way = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, seen, k = work.keep(one_way, f"{tag}-0"), None, 0
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        k += 1
        now = work.keep(small.where("u <> v").distinct(), f"{tag}-{k}")
        if k > 1:
            work.drop(f"{tag}-{k - 2}")
