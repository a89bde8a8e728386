"""Distributed global row numbering (R1) and ordered top-k.

``row_number()`` over an un-partitioned window moves every row into one task.
Instead: range-partition by the sort order, number rows inside each partition,
and add the row count of all earlier partitions (a table with one row per
partition, so its broadcast is bounded by the partition count).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonecast.session import cut_lineage


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """1-based position of each row in the total order ``order`` (must be a total order)."""
    sorted_ = df.orderBy(*order).withColumn("__pid", F.spark_partition_id())
    # Fix the partition assignment so the count job and the numbering agree.
    sorted_ = cut_lineage(sorted_)
    local = sorted_.withColumn(
        "__local", F.row_number().over(Window.partitionBy("__pid").orderBy(*order)))
    counts = sorted_.groupBy("__pid").agg(F.count("*").alias("__cnt"))
    offsets = counts.withColumn(
        "__off", F.coalesce(F.sum("__cnt").over(
            Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (local.join(F.broadcast(offsets.select("__pid", "__off")), "__pid")
            .withColumn(name, (F.col("__local") + F.col("__off")).cast("int"))
            .drop("__pid", "__local", "__off"))


def grouped_row_number(df: DataFrame, group: str, order: list[Column],
                       name: str = "row_number") -> DataFrame:
    """1-based position within ``group`` without a per-group window: number the
    whole table in (group, order) and subtract each group's starting offset
    (one row per group, from a partial-aggregated count, broadcast after a size
    check)."""
    numbered = global_row_number(df, [F.col(group).asc()] + order, "__gn")
    counts = df.groupBy(group).agg(F.count("*").alias("__c"))
    starts = counts.withColumn("__start", F.coalesce(F.sum("__c").over(
        Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    from zonecast.operators.joins import maybe_broadcast
    return (numbered.join(maybe_broadcast(starts.select(group, "__start")), group)
            .withColumn(name, (F.col("__gn") - F.col("__start")).cast("int"))
            .drop("__gn", "__start"))
