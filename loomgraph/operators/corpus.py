"""From files to metadata, mentions and topic counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import exprs as X
from loomgraph.operators.mentions import MOST_SHARDS, joined_mentions, scanned_mentions, shards_needed
from loomgraph.operators.ranking import numbered
from loomgraph.sources.tables import settled


def as_files(documents: DataFrame) -> DataFrame:
    """documents as files: file_name, content."""
    return documents.select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"), F.coalesce("text", F.lit("")).alias("content"))


def file_metadata(files: DataFrame) -> DataFrame:
    """Per file: its stem, size in bytes, node size, links, SHA-1 and mass."""
    size = F.octet_length("content").cast("long")
    return files.select(
        "file_name",
        X.stem(F.col("file_name")).alias("metadata_id"),
        size.alias("file_size"),
        X.node_size(size).alias("node_size"),
        X.link_count(F.col("content")).alias("hyperlink_count"),
        F.sha1(F.col("content").cast("binary")).alias("sha1"),
        X.mass(size).alias("mass"),
        X.mass(size, 0).alias("wire_mass"),
    )


def ingest(files: DataFrame, marker: str) -> DataFrame:
    """Metadata of the public files: those that begin with marker."""
    return file_metadata(files.filter(X.is_public(F.col("content"), marker)))


def listing_statistics(listing: DataFrame) -> DataFrame:
    """Entries, files and Markdown files of a listing (name, type)."""
    return listing.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("type") == "file").alias("files"),
        F.count_if((F.col("type") == "file") & F.col("name").endswith(".md")).alias("markdown"),
    )


def vocabulary(names: DataFrame, column: str) -> DataFrame:
    """Distinct names (name, low), as they are and lowered; null and empty ones are no names."""
    distinct = names.select(F.col(column).alias("name")).filter("name IS NOT NULL AND name != ''").distinct()
    return distinct.select("name", F.lower("name").alias("low"))


def mentions(files: DataFrame, names: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, name, n): how often each name of a vocabulary stands in each file as a whole, ignoring case and without overlap.

    Both ends of a name must be word borders. Files are scanned once per shard of the vocabulary; one of more than
    MOST_SHARDS shards goes through a join of the files' words instead.
    """
    names = settled(names, "vocabulary")
    shards = shards_needed(names)
    if shards > MOST_SHARDS:
        return joined_mentions(files, names, key, content)
    found = scanned_mentions(files, names, key, content, shards)
    if found is None:
        return files.select(key, F.lit("").alias("name"), F.lit(0).cast("long").alias("n")).limit(0)
    return found


def topic_maps(counts: DataFrame, key: str) -> DataFrame:
    """Per key the map of names to counts; a key's names are bounded by its own content."""
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("topic_counts"))


def missing_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Names of wanted without a file."""
    return wanted.join(files, "file_name", "left_anti").select("file_name").distinct()


def with_new_ids(metadata: DataFrame, id_col: str = "node_id", order: str = "metadata_id") -> DataFrame:
    """Valid stored ids stay; the others get the numbers after the largest, in order of metadata_id."""
    known = metadata.withColumn("id", X.parsed_id(F.col(id_col)))
    largest = known.agg(F.max("id")).first()[0] or 0
    fresh = numbered(known.filter("id = 0"), order, name="_row").withColumn("id", F.col("_row") + 1 + largest).drop("_row")
    return known.filter("id != 0").unionByName(fresh)


def page_list(files: DataFrame, modified: DataFrame) -> DataFrame:
    """Per file: id, title, path and the last modification in epoch seconds, 0 if unknown."""
    latest = modified.groupBy("file_name").agg(F.max("ts").alias("ts"))
    return files.join(latest, "file_name", "left").select(
        "file_name",
        X.stem_once(F.col("file_name")).alias("title"),
        F.concat(F.lit("/pages/"), F.col("file_name")).alias("path"),
        F.coalesce(F.unix_timestamp("ts"), F.lit(0)).cast("long").alias("modified"),
    )
