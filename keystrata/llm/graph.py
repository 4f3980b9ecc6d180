"""Connected components of an edge table, by alternating large and small stars; nothing comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import join_apart, remove, written


def components(edges: DataFrame, folder: str, tag: str) -> DataFrame:
    """Rows (node, component) of every node that has an edge (u, v); component is the smallest node reachable.

    Each round writes its edges to the shared folder, so a lost executor costs that round at most. Hubs are aggregated
    before they are shuffled, and Spark can split the joins that follow where a node is hot.
    Null ends and loops are left out; an empty table gives an empty one.
    """
    current = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), folder, f"{tag}-0")
    last, step = None, 0
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = join_apart(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_apart(large, low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        step += 1
        following = written(small, folder, f"{tag}-{step}")
        state = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(current.sparkSession, f"{folder}/{tag}-{step - 1}")
        current = following
        if state == last:
            break
        last = state
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
