"""Tables, listings and snapshots as DataFrames with explicit schemas."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METADATA = T.StructType(
    [
        T.StructField("file_name", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("node_size", T.DoubleType()),
        T.StructField("hyperlink_count", T.LongType()),
        T.StructField("sha1", T.StringType()),
        T.StructField("node_id", T.StringType()),
        T.StructField("last_modified", T.TimestampType()),
        T.StructField("perplexity_link", T.StringType()),
        T.StructField("last_perplexity_process", T.TimestampType()),
        T.StructField("topic_counts", T.MapType(T.StringType(), T.LongType())),
    ]
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def listing(spark: SparkSession, folder: str, suffix: str = ".md") -> DataFrame:
    """Files below a folder whose names end with suffix: path, file_name, file_size, last_modified, content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(folder)
    return found.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("last_modified"),
        F.decode("content", "UTF-8").alias("content"),
    )


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata rows from JSON lines; missing fields take their defaults; no rows where nothing was written yet."""
    try:
        rows = spark.read.schema(METADATA).json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], METADATA)
    return rows.fillna({"file_size": 0, "node_size": 0.0, "hyperlink_count": 0, "sha1": "", "node_id": "0", "perplexity_link": ""})


def save_metadata(files: DataFrame, path: str) -> None:
    """Metadata rows as JSON lines, in place of what was there."""
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in METADATA if f.name not in files.columns]
    files.select("*", *absent).select(*METADATA.names).write.mode("overwrite").json(path)


#: Rows that one task should hold at once, about, whatever the size of a table.
TASK_ROWS = 1 << 18


def spread(df: DataFrame, rows: int, *keys: str, most: int = TASK_ROWS) -> DataFrame:
    """df dealt by keys, or evenly without any, so that a task gets about `most` of its rows; as Spark deals it where that is enough.

    The number is fixed, since rows of a few bytes would otherwise be put together by their size, and meet by the million.
    """
    parts = max(-(-rows // most), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if keys and rows > most else 1)
    return df.repartition(parts, *keys)


def file_names(files: DataFrame) -> DataFrame:
    return files.select("file_name")


def named_file(files: DataFrame, name: str) -> DataFrame:
    """The file of a name, pushed down to the scan."""
    return files.filter(F.col("file_name") == name)


def layout_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows (id, x, y, z) of a JSON array of [id, x, y, z] arrays."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "array<array<string>>")).alias("r"))
    part = lambda i: F.get("r", i).cast("double")
    return rows.select(F.get("r", 0).alias("id"), part(1).alias("x"), part(2).alias("y"), part(3).alias("z"))


_own: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir)."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="loomgraph-"))
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written to the shared folder (with the writer's options) and read again, so that its lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame | None) -> None:
    """Remove the files of a settled table that nothing reads any more."""
    for path in df.inputFiles() if df is not None else []:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
        return


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, what a job has shuffled is removed at its end, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
