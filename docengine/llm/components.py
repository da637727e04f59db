"""Connected components by alternating large-star and small-star, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.store import apart, table


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of every node of `edges` (a, b), component being the smallest node it reaches.

    Null ends and loops link nothing; repeated edges count once; no edges give an empty frame. Each
    round writes its edges to the shared folder, so a lost executor costs at most that round. Minima
    are pre-aggregated before the shuffle and dealt anew, so that hot nodes meet only joins of plain shuffles, which Spark can split. Nodes are longs.
    Raises if `rounds` do not suffice (they grow with the logarithm of the longest path).
    """
    e = table(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = None
    for _ in range(rounds):
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", F.col("v")).distinct())
        seen = state
        both = e.union(e.select("v", "u"))
        low = apart(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "u")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = apart(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        e = table(small.distinct(), "edges")
    raise RuntimeError(f"components have not settled in {rounds} rounds")
