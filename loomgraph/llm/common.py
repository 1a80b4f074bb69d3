"""Helpers that the corpus operators share: table access, shared scratch tables, partition sizing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by its path; only Spark opens it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is missing, as in tests on a local master, a folder of our own is taken.
    """
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    key = context.applicationId
    if key not in _own_dirs:
        _own_dirs[key] = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    return _own_dirs[key]


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again.

    Unlike checkpoint() the copy is compressed, has statistics and lets columns be pruned.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches kept to a few megabytes.

    A task holds a batch in the JVM, in flight and in Python; the default of 64 MB each would let
    long texts fill an executor that is small.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 2000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return df


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder; Spark's cleaner removes it once unused."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint(eager=True)


#: A key with at least this share of all rows is joined by broadcast; there can't be more such keys than this.
HOT_KEYS = 1000


def looked_up(rows: DataFrame, values: DataFrame, key: Column, size: str, fields: list[str], spread: Column) -> DataFrame:
    """rows (left join) with the fields of values, one row per key in its column "key", by the key column of rows.

    size is the column of values that tells how many rows have the key. Keys with at least one row in HOT_KEYS
    are at most HOT_KEYS and come by broadcast; their rows, and rows whose key is null, take part in the shuffle
    for the other keys under spread, a value of the key's type that meets no key and differs between rows.
    """
    total = values.agg(F.sum(size)).first()[0] or 0
    busy = F.col(size) * HOT_KEYS >= total
    one = lambda df, name: df.select(F.col("key").alias(f"_{name}_key"), F.struct(*fields).alias(f"_{name}"))
    hot, rest = one(values.filter(busy), "hot"), one(values.filter(~busy), "rest")
    rows = rows.withColumn("_key", key)
    seen = rows.join(F.broadcast(hot), F.col("_key") == F.col("_hot_key"), "left").drop("_hot_key")
    dealt = F.when(F.col("_hot").isNotNull() | F.col("_key").isNull(), spread).otherwise(F.col("_key"))
    found = seen.withColumn("_key", dealt).join(rest, F.col("_key") == F.col("_rest_key"), "left")
    return found.select(*(c for c in rows.columns if c != "_key"), *(F.coalesce(F.col("_hot")[f], F.col("_rest")[f]).alias(f) for f in fields))


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of an ASCII text."""
    bits = "list_reduce(list_concat([xor(a, b)], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: {bits}))"
