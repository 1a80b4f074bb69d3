"""Queries over files, mentions and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import exprs as X
from loomgraph.operators import corpus as C
from loomgraph.operators import graph as G
from loomgraph.operators.ranking import numbered
from loomgraph.sources import tables as T
from loomgraph.sources.tables import table

_FILES = "SELECT doc_id, 'doc_' || doc_id || '.md' AS file_name, coalesce(text, '') AS content FROM documents"
_MASS = "CAST(trunc(least(greatest(log10(CAST(strlen(content) AS DOUBLE) + 1) / CAST(4 AS DOUBLE), CAST(0.1 AS DOUBLE)), CAST(10 AS DOUBLE)) * CAST(25.5 AS DOUBLE)) AS INTEGER)"
_META = f"""SELECT file_name, regexp_replace(file_name, '(\\.md)+$', '') AS metadata_id, strlen(content) AS file_size,
  CAST(5 AS DOUBLE) + least(strlen(content) / CAST(1000 AS DOUBLE), CAST(5 AS DOUBLE)) * CAST(9 AS DOUBLE) AS node_size,
  len(regexp_extract_all(content, '\\[([^\\]]+)\\]\\(([^)]+)\\)')) AS hyperlink_count, sha1(content) AS sha1,
  greatest(1, {_MASS}) AS mass, {_MASS} AS wire_mass FROM f"""
_HREFS = "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"]+)\"', 1)) AS target FROM pages"
_WORD = "[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}]+"


# Two marks stand at each border of a word; a name between borders has one of them at either end.
def _marked(text: str) -> str:
    return f"regexp_replace(lower({text}), '({_WORD})', chr(31) || chr(31) || '\\1' || chr(31) || chr(31), 'g')"



def _files(spark: SparkSession, d: str) -> DataFrame:
    return C.as_files(table(spark, d, "documents"))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), 1)
    return table(spark, d, "pages").select("page_id", F.explode(found).alias("target"))


def file_metadata(spark: SparkSession, d: str) -> DataFrame:
    return C.file_metadata(_files(spark, d))


def public_files(spark: SparkSession, d: str) -> DataFrame:
    return C.ingest(_files(spark, d), "The").select("file_name", "file_size", "sha1")


def public_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Files that begin with wide blanks of three bytes, then blanks: the marker must end within the first 101 bytes."""
    lead = F.concat(F.repeat(F.lit("\u3000"), (F.col("doc_id") % 40).cast("int")), F.repeat(F.lit(" "), (F.col("doc_id") % 5).cast("int")))
    content = F.concat(lead, F.lit("public:: true\n"), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", X.is_public(content).alias("public"))


def markdown_listing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    ending = F.when(F.col("doc_id") % 3 == 0, ".txt").otherwise(".md")
    kind = F.when(F.col("doc_id") % 7 == 0, "dir").otherwise("file")
    return C.listing_statistics(docs.select(F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), ending).alias("name"), kind.alias("type")))


def page_hyperlinks(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return pages.select("page_id", X.link_count(F.col("html"), X.HREF).alias("links"), X.link_count(F.col("html")).alias("markdown_links"))


def topic_counts(spark: SparkSession, d: str) -> DataFrame:
    names = C.vocabulary(_targets(spark, d), "target")
    return C.mentions(_files(spark, d), names, "doc_id")


def topic_counts_map(spark: SparkSession, d: str) -> DataFrame:
    maps = C.topic_maps(topic_counts(spark, d), "doc_id")
    return maps.select("doc_id", F.size("topic_counts").cast("long").alias("topics"), F.aggregate(F.map_values("topic_counts"), F.lit(0).cast("long"), lambda a, x: a + x).alias("mentions"))


def _mentions_sql(names: str) -> str:
    """CTE m (doc_id, name, n): whole-word mentions without overlap of the names that a query gives."""
    return f"""v AS (SELECT DISTINCT name, chr(31) || trim({_marked('name')}, chr(31)) || chr(31) AS w FROM ({names}) WHERE name <> ''),
d AS (SELECT doc_id, {_marked('text')} AS t FROM documents WHERE text IS NOT NULL),
m AS (SELECT * FROM (SELECT doc_id, name, CAST((length(t) - length(replace(t, w, ''))) // length(w) AS BIGINT) AS n FROM d, v WHERE contains(t, w)) WHERE n > 0)"""


_TOPICS = _mentions_sql(f"SELECT target AS name FROM ({_HREFS})")


def phrase_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Names as they are written: the first two words of each benchmark item and every one of them with its signs."""
    words = F.split(F.trim("text"), r"\s+")
    phrases = table(spark, d, "benchmark").select(F.explode(F.array_append(words, F.array_join(F.slice(words, 1, 2), " "))).alias("phrase"))
    return C.mentions(_files(spark, d), C.vocabulary(phrases, "phrase"), "doc_id")


def mention_edges(spark: SparkSession, d: str) -> DataFrame:
    """Names of one page mention each other's page: from its first link target to all the others."""
    targets = _targets(spark, d)
    first = table(spark, d, "pages").select("page_id", F.regexp_extract("html", 'href="/([^"]+)"', 1).alias("source_name"))
    nodes = _named(targets)
    counts = targets.join(first, "page_id").filter("target != source_name").groupBy("source_name", F.col("target").alias("target_name")).agg(F.count(F.lit(1)).alias("weight"))
    return G.undirected_edges(G.resolved(counts, nodes))


def _named(targets: DataFrame) -> DataFrame:
    return numbered(targets.select(F.col("target").alias("metadata_id")).distinct(), "metadata_id", name="id").withColumn("id", F.col("id") + 1)


def node_table(spark: SparkSession, d: str) -> DataFrame:
    meta = C.file_metadata(_files(spark, d))
    nodes = C.with_new_ids(meta.withColumn("node_id", F.lit("0"))).withColumn("last_modified", F.lit(None).cast("timestamp"))
    built = G.node_metadata(nodes)
    value = lambda k: F.col("metadata")[k].alias(f"m_{k}")
    return built.select("id", "metadata_id", value("fileName"), value("name"), value("fileSize"), value("sha1"), F.size("metadata").alias("entries"))


def max_node_id(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("c_custkey") % 10 == 0, F.col("c_name")).otherwise(F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").agg(F.coalesce(F.max(X.parsed_id(text)), F.lit(0)).alias("max_id"), F.count_if(X.parsed_id(text) == 0).alias("invalid"))


def missing_files(spark: SparkSession, d: str) -> DataFrame:
    wanted = C.as_files(table(spark, d, "documents")).select("file_name")
    have = table(spark, d, "labels").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"))
    return C.missing_files(wanted, have)


def page_list_modified(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "customer").select(F.concat("c_name", F.lit(".md")).alias("file_name"), "c_custkey")
    times = table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    modified = times.join(files, F.col("o_custkey") == F.col("c_custkey")).select("file_name", "ts")
    return C.page_list(files.select("file_name"), modified)


def file_names(spark: SparkSession, d: str) -> DataFrame:
    return T.file_names(_files(spark, d))


def file_by_name(spark: SparkSession, d: str) -> DataFrame:
    return T.named_file(_files(spark, d), "doc_7.md").select("file_name", "content")


def file_listing(spark: SparkSession, d: str) -> DataFrame:
    """A folder of files per source, listed with their sizes: some end as wanted, others don't."""
    path = T.scratch_path(spark, "listing")
    docs = table(spark, d, "documents").select("source", F.when(F.col("doc_id") % 3 == 0, "other").otherwise("wanted").alias("kind"), F.col("doc_id").cast("string"))
    for kind, compressed in (("wanted", "none"), ("other", "gzip")):  # .txt and .txt.gz
        docs.filter(F.col("kind") == kind).drop("kind").write.mode("append").partitionBy("source").option("compression", compressed).text(path)
    found = T.listing(spark, path, ".txt")
    return found.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")).agg(F.sum("file_size").alias("bytes"))


def layout_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Positions saved as JSON arrays of a thousand nodes each, and loaded again."""
    path = T.scratch_path(spark, "snapshot")
    part = lambda i: F.col("embedding")[i].cast("double")
    nodes = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 1000).alias("part"), F.array(F.concat(F.lit('"'), F.col("vec_id").cast("string"), F.lit('"')), *(F.format_string("%.6f", part(i)) for i in range(3))).alias("row"))
    lines = nodes.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: F.concat(F.lit("["), F.array_join(r, ", "), F.lit("]"))), ", ").alias("rows"))
    lines.select("part", F.concat(F.lit("["), "rows", F.lit("]"))).repartition("part").write.partitionBy("part").text(path)
    loaded = T.layout_snapshot(spark, path)
    return loaded.select(F.col("id").cast("long").alias("id"), *(X.rounded(c, 6).alias(c) for c in "xyz"))


def metadata_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Metadata saved as JSON lines and loaded with its defaults."""
    path = T.scratch_path(spark, "metadata")
    meta = C.file_metadata(_files(spark, d)).withColumn("node_id", F.lit("3"))
    T.save_metadata(meta, path)
    loaded = T.load_metadata(spark, path)
    return loaded.select("file_name", "file_size", "node_size", "hyperlink_count", "sha1", "node_id", "perplexity_link")


CATALOG = {
    "file_names": (file_names, f"SELECT file_name FROM ({_FILES})"),
    "file_by_name": (file_by_name, f"SELECT file_name, content FROM ({_FILES}) WHERE file_name = 'doc_7.md'"),
    "file_listing": (file_listing, "SELECT source, CAST(sum(length(CAST(doc_id AS VARCHAR)) + 1) AS BIGINT) AS bytes FROM documents WHERE doc_id % 3 <> 0 GROUP BY source"),
    "layout_snapshot": (layout_snapshot, f"SELECT vec_id AS id, {', '.join(f'round(CAST(embedding[{i}] AS DOUBLE), 6) AS {c}' for i, c in enumerate('xyz', 1))} FROM embeddings"),
    "metadata_roundtrip": (metadata_roundtrip, f"WITH f AS ({_FILES}), m AS ({_META}) SELECT file_name, file_size, node_size, hyperlink_count, sha1, '3' AS node_id, '' AS perplexity_link FROM m"),
    "file_metadata": (file_metadata, f"WITH f AS ({_FILES}) {_META}"),
    "public_files": (public_files, f"WITH f AS ({_FILES}), m AS ({_META}) SELECT m.file_name, m.file_size, m.sha1 FROM m JOIN f USING (file_name) WHERE starts_with(regexp_replace(substring(f.content, 1, 101), '^\\s+', ''), 'The')"),
    "public_prefix": (public_prefix, "SELECT doc_id, 3 * (doc_id % 40) + doc_id % 5 + 13 <= 101 AS public FROM documents"),
    "markdown_listing": (markdown_listing, """SELECT count(*) AS total, count(*) FILTER (doc_id % 7 <> 0) AS files,
      count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 3 <> 0) AS markdown FROM documents"""),
    "page_hyperlinks": (page_hyperlinks, """SELECT page_id, len(regexp_extract_all(html, 'href="([^"]+)"')) AS links, len(regexp_extract_all(html, '\\[([^\\]]+)\\]\\(([^)]+)\\)')) AS markdown_links FROM pages"""),
    "topic_counts": (topic_counts, f"WITH {_TOPICS} SELECT doc_id, name, n FROM m"),
    "topic_counts_map": (topic_counts_map, f"WITH {_TOPICS} SELECT doc_id, count(*) AS topics, CAST(sum(n) AS BIGINT) AS mentions FROM m GROUP BY doc_id"),
    "phrase_mentions": (phrase_mentions, f"""WITH b AS (SELECT regexp_split_to_array(trim(text), '\\s+') AS w FROM benchmark),
      {_mentions_sql("SELECT array_to_string(w[1:2], ' ') AS name FROM b UNION ALL SELECT unnest(w) FROM b")} SELECT doc_id, name, n FROM m"""),
    "mention_edges": (mention_edges, f"""WITH t AS ({_HREFS}), f AS (SELECT page_id, regexp_extract(html, 'href="/([^"]+)"', 1) AS s FROM pages),
      n AS (SELECT target AS name, row_number() OVER (ORDER BY target) AS id FROM (SELECT DISTINCT target FROM t)),
      e AS (SELECT a.id AS x, b.id AS y FROM t JOIN f USING (page_id) JOIN n a ON a.name = f.s JOIN n b ON b.name = t.target WHERE f.s <> t.target)
      SELECT least(x, y) || '-' || greatest(x, y) AS id, least(x, y) AS source, greatest(x, y) AS target, count(*) AS weight FROM e GROUP BY 1, 2, 3"""),
    "node_table": (node_table, f"""WITH f AS ({_FILES}), m AS ({_META}) SELECT row_number() OVER (ORDER BY metadata_id) AS id, metadata_id, file_name AS "m_fileName",
      metadata_id AS m_name, CAST(file_size AS VARCHAR) AS "m_fileSize", sha1 AS m_sha1, 7 AS entries FROM m"""),
    "max_node_id": (max_node_id, """SELECT coalesce(max(i), 0) AS max_id, count(*) FILTER (i = 0) AS invalid
      FROM (SELECT CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_custkey END AS i FROM customer)"""),
    "missing_files": (missing_files, "SELECT 'doc_' || doc_id || '.md' AS file_name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "page_list_modified": (page_list_modified, """SELECT c_name || '.md' AS file_name, c_name AS title, '/pages/' || c_name || '.md' AS path,
      coalesce(CAST(epoch(max(o_orderdate)) AS BIGINT), 0) AS modified FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_name"""),
}
