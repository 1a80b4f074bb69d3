"""Pages of a table that is sorted once and kept in parts whose row ranges are known."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.sources.tables import scratch_path


@dataclass
class PageIndex:
    """path: a folder of sorted parts, one file each; parts: (part, first row, rows) in order, one entry per file."""

    spark: SparkSession
    path: str
    schema: T.StructType
    parts: list[tuple[int, int, int]]

    @classmethod
    def build(cls, rows: DataFrame, order: str, path: str | None = None) -> PageIndex:
        """Sort rows by ranges of order, null first, and write them with their index below path; one shuffle, ever."""
        path = path or scratch_path(rows.sparkSession, "pages")
        dealt = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
        dealt = dealt.withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
        dealt.write.partitionBy("_part").parquet(f"{path}/rows")
        stored = rows.sparkSession.read.schema(dealt.schema).parquet(f"{path}/rows")
        stored.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{path}/index")
        rows.limit(0).write.parquet(f"{path}/schema")
        return cls.open(rows.sparkSession, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PageIndex:
        """An index that was built before; its entries, one per file, are read here."""
        first, parts = 0, []
        for part, n in spark.read.schema("_part int, n long").parquet(f"{path}/index").orderBy("_part").collect():
            parts.append((part, first, n))
            first += n
        return cls(spark, path, spark.read.parquet(f"{path}/schema").schema, parts)

    @property
    def total(self) -> int:
        return sum(n for _, _, n in self.parts)

    def rows(self, low: int, high: int) -> DataFrame:
        """Rows low to high - 1: only the files that hold some of them are listed, and in them only the row groups."""
        kept = T.StructType([*self.schema.fields, T.StructField("_at", T.LongType()), T.StructField("_part", T.IntegerType())])
        stored = self.spark.read.schema(kept).parquet(f"{self.path}/rows")
        near = [(part, max(low - first, 0), min(high - first, n)) for part, first, n in self.parts if first < high and low < first + n]
        inside = F.lit(False)
        for part, a, b in near:
            inside = inside | ((F.col("_part") == part) & F.col("_at").between(a, b - 1))
        return stored.filter(F.col("_part").isin([part for part, _, _ in near])).filter(inside).drop("_part", "_at")

    def page(self, number: int, page_size: int = 100, first: int = 1) -> tuple[DataFrame, dict]:
        """(rows of the page, {total, total_pages, page}); pages count from first; an empty table has one page of none."""
        if page_size <= 0:
            raise ValueError("page_size must be positive")
        pages, at = -(-self.total // page_size), number - first
        if at < 0 or (pages and at >= pages):
            raise ValueError(f"page {number} is not among {pages} pages")
        return self.rows(at * page_size, (at + 1) * page_size), {"total": self.total, "total_pages": pages, "page": number}
