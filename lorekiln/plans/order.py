"""Neighbours in a global order without one task per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.plans.stage import Stages


def with_previous(df: DataFrame, group: list[str], order: list[str], take: str, name: str) -> DataFrame:
    """``df`` with ``name``: the value of ``take`` in the row before, within ``group`` and by ``order``; null for the
    first of a group.

    Rows are range-partitioned over (group, order), so a hot group spans many tasks; each part looks back within
    itself, and only the last row of each part is passed on to the next.
    """
    work = Stages(df.sparkSession, "order")
    keys = [*group, *order]
    parts = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    parts = work.put(parts, "parts")
    inside = Window.partitionBy("_part").orderBy(*keys)
    g = F.struct(*group)
    rows = parts.select("*", F.lag(F.struct(g.alias("g"), F.col(take).alias("v"))).over(inside).alias("_back"))
    ends = parts.groupBy("_part").agg(F.max_by(F.struct(g.alias("g"), F.col(take).alias("v")), F.struct(*keys)).alias("_end"))
    before = ends.select("_part", F.lag("_end").over(Window.orderBy("_part")).alias("_far"))  # one row a part
    rows = rows.join(F.broadcast(before), "_part", "left")
    back = F.coalesce("_back", "_far")
    same = back["g"].eqNullSafe(g)
    return rows.withColumn(name, F.when(same, back["v"])).drop("_part", "_back", "_far")


def with_ordinal(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the place of each row by ``order``, from 0 on. Rows are numbered within range partitions;
    what stands before a partition is summed over one row a partition."""
    work = Stages(df.sparkSession, "ordinal")
    parts = work.put(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "parts")
    size = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = size.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a part
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = parts.withColumn("_i", inside).join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_i") - 1).drop("_part", "_i", "_before")


def quantile(df: DataFrame, column: str, share: float, name: str) -> DataFrame:
    """One row with the exact quantile of a column, between two values by linear interpolation; null without values. The
    column is sorted over range partitions, so no task holds all its distinct values."""
    rows = with_ordinal(df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")), ["v"], "i")
    at = rows.agg(((F.count("*") - 1) * F.lit(share)).alias("at"))  # one row
    near_by = rows.join(F.broadcast(at)).where(F.col("i").between(F.floor("at"), F.ceil("at")))  # two rows at most
    low, high = F.min_by("v", "i"), F.max_by("v", "i")
    return near_by.agg((low + (high - low) * (F.max("at") - F.min("i"))).alias(name))
