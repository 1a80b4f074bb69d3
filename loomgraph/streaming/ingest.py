"""Files that arrive as a stream, kept as metadata by name: replays change nothing, changed files replace their row, bad ones go aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import exprs as X
from loomgraph.operators.corpus import file_metadata
from loomgraph.sources.stores import BucketStore

#: What Spark's reader of whole files gives.
BINARY = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, suffix: str = ".md", per_batch: int = 1000) -> DataFrame:
    """Files below a folder as a stream, in the order of their times.

    Spark takes each path once: a changed file must arrive under another folder, since rows go by the file's name alone.
    """
    return spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)


def parsed(files: DataFrame, marker: str) -> tuple[DataFrame, DataFrame]:
    """(metadata of public files, files set aside with the reason): text must be UTF-8; of one name the latest file counts."""
    named = files.withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    latest = named.groupBy("file_name").agg(F.max_by(F.struct("modificationTime", "content"), F.struct("modificationTime", "path")).alias("f")).select("file_name", F.col("f.modificationTime").alias("last_modified"), F.col("f.content").alias("raw"))
    text = latest.withColumn("content", F.try_validate_utf8(F.col("raw").cast("string")))
    good = text.filter(F.col("content").isNotNull() & X.is_public(F.col("content"), marker))
    meta = file_metadata(good).join(good.select("file_name", "last_modified"), "file_name")
    reason = F.when(F.col("content").isNull(), "not UTF-8").otherwise("not public")
    aside = text.filter(F.col("content").isNull() | ~X.is_public(F.col("content"), marker)).select("file_name", "last_modified", reason.alias("reason"), F.sha1("raw").alias("sha1"))
    return meta, aside


METADATA = "file_name string, metadata_id string, file_size long, node_size double, hyperlink_count long, sha1 string, mass int, wire_mass int, last_modified timestamp"
ASIDE = "file_name string, last_modified timestamp, reason string, sha1 string"


class Ingest:
    """A folder with the metadata by file name and, beside it, the files that were not taken."""

    def __init__(self, spark: SparkSession, path: str, marker: str = "public:: true", buckets: int = 16):
        self.marker = marker
        store = lambda name, schema: BucketStore(spark, f"{path}/{name}", "file_name", buckets, T._parse_datatype_string(schema))
        self.kept, self.aside = store("metadata", METADATA), store("aside", ASIDE)
        for s in (self.kept, self.aside):
            spark.createDataFrame([], s.schema).write.mode("ignore").parquet(f"{s.path}/_bucket=0")

    def _changed(self, rows: DataFrame, store: BucketStore) -> DataFrame:
        """Rows whose name is new, or whose content differs from the kept one and is not older."""
        old = store.rows(store.touched(rows)).select("file_name", F.col("sha1").alias("_sha1"), F.col("last_modified").alias("_at"))
        joined = rows.join(old, "file_name", "left")
        return joined.filter(F.col("_sha1").isNull() | ((F.col("_sha1") != F.col("sha1")) & (F.col("last_modified") >= F.col("_at")))).drop("_sha1", "_at")

    def take(self, files: DataFrame, batch: int = 0) -> None:
        """One micro-batch; taken again it finds nothing changed."""
        meta, aside = parsed(files.persist(), self.marker)
        try:
            for rows, store, other in ((meta, self.kept, self.aside), (aside, self.aside, self.kept)):
                changed = self._changed(rows, store)
                if store.upsert(changed):
                    other.delete(rows.select("file_name"))
        finally:
            files.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Run over a stream of files (arriving); Spark may repeat the last micro-batch after a failure."""
        return stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
