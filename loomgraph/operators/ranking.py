"""Numbering of rows in a global order without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.sources.tables import settled


def numbered(df: DataFrame, *order: Column | str, name: str = "row") -> DataFrame:
    """df with name = 0, 1, ... along order, which must be unique.

    Rows are range-partitioned and numbered within partitions; only one row per partition meets in a
    single task, for the offsets.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    part = settled(placed.withColumn("_part", F.shiftright("_id", 33)), "numbered")  # a partition's rows count in the lower 33 bits
    sizes = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    return part.join(offsets, "_part").withColumn(name, F.col("_base") + F.col("_id")).drop("_part", "_base", "_id")
