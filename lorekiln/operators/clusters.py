"""Clusters of near-duplicate rows from scored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.plans.stage import Stages


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, cluster): cluster is the smallest node reached. Stars are contracted in turns: every node hands its larger
    neighbours to its smallest one, then every node its smaller neighbours, until the edges are stars; the number of
    rounds is logarithmic in the size of a cluster, and partial aggregation takes the smallest neighbour of a hub."""
    work = Stages(edges.sparkSession, "clusters")
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    e = work.put(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(u, v).where("u <> v").distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        j = both.join(low, "u")
        moved = j.where("v > u") if large else j.where("v <> m")
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            out = out.unionByName(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    while True:
        nxt = work.put(star(star(e, True), False), "edges")
        done = nxt.exceptAll(e).limit(1).count() == 0 and e.exceptAll(nxt).limit(1).count() == 0
        work.drop(e)
        e = nxt
        if done:
            break
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("cluster")).unionByName(roots.select("node", F.col("node").alias("cluster")))
