"""Global positions: every row's place in an order, as a whole or within its group, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.llm.common import written

#: monotonically_increasing_id counts a partition's rows in its lower 33 bits.
_ROW_BITS = 33


def in_order(df: DataFrame, order: list, name: str) -> DataFrame:
    """df by ranges of order, sorted and written, with _part (ascending along the order) and _at, the row's place in its part.

    The sample for the ranges runs df once more, so df should be a scan or a written table. Rows that are equal in all
    of order meet in one part: give a last column that tells repeated rows apart.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return written(placed.withColumn("_part", F.shiftright("_id", _ROW_BITS)).withColumn("_at", F.col("_id") - F.shiftleft("_part", _ROW_BITS)).drop("_id"), name)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """in_order(df) with row = 0, 1, ... over all rows; one row per part meets in a single task, for the offsets."""
    parts = in_order(df, order, name)
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return parts.join(bases, "_part").withColumn("row", F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def ranked(df: DataFrame, group: str, order: list, name: str) -> tuple[DataFrame, DataFrame]:
    """(df with rank = 0, 1, ... within its group along order, groups with their size).

    A group that holds most rows is spread over many parts; only (part, group) pairs are added up, at most one per part
    and group. Null is a group of its own.
    """
    parts = in_order(df, [F.col(group).asc_nulls_first(), *order], name)
    pieces = parts.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = pieces.select(F.col(group).alias("_group"), F.col("_part").alias("_piece"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    rows = parts.join(bases, parts[group].eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_piece")))
    return (
        rows.withColumn("rank", F.col("_base") + F.col("_at")).drop("_part", "_at", "_base", "_group", "_piece"),
        pieces.groupBy(group).agg(F.sum("_n").alias("size")),
    )
