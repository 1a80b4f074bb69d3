"""Queries over nodes, edges, search and access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import exprs as X
from loomgraph.operators import access as A
from loomgraph.operators import graph as G
from loomgraph.operators import search as S
from loomgraph.operators.paging import PageIndex
from loomgraph.operators.search_index import SearchIndex
from loomgraph.sources.stores import GraphStore
from loomgraph.sources.tables import scratch_path, spread, table

_EDGES = """e AS (SELECT a.l_partkey AS s, b.l_partkey AS t FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a
  JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey),
w AS (SELECT s || '-' || t AS id, s AS source, t AS target, count(*) AS weight FROM e GROUP BY s, t)"""


def edge_weights(spark: SparkSession, d: str) -> DataFrame:
    """Parts that share orders; an order has few lines."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    rows = lines.count()
    held = spread(lines, rows, "l_orderkey").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    pairs = held.select("parts", F.explode("parts").alias("source")).select("source", F.explode("parts").alias("target")).filter("source < target").withColumn("weight", F.lit(1).cast("long"))
    return G.undirected_edges(pairs, rows=2 * rows)  # an order of a few lines has about twice as many pairs


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_retailprice").alias("weight"))


def graph_health(spark: SparkSession, d: str) -> DataFrame:
    return G.health(metadata=table(spark, d, "documents"), nodes=table(spark, d, "part"), edges=edge_weights(spark, d))


_indexes: dict[tuple[str, str], PageIndex] = {}


def _paged_parts(spark: SparkSession, d: str) -> PageIndex:
    """The parts' page index: built by the first query of a session that asks for a page of a folder's table."""
    key = spark.sparkContext.applicationId, d
    if key not in _indexes:
        _indexes[key] = PageIndex.build(_parts(spark, d), "id")
    return _indexes[key]


def graph_page(spark: SparkSession, d: str) -> DataFrame:
    rows, about = _paged_parts(spark, d).page(2, 75)
    return rows.select("id", "label", F.lit(about["total"]).cast("long").alias("total"), F.lit(about["total_pages"]).cast("long").alias("total_pages"))


def graph_page_edges(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = _paged_parts(spark, d).page(2, 75)
    return G.touching(edge_weights(spark, d), rows)


def first_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that count from 0: the third one."""
    rows, about = _paged_parts(spark, d).page(2, 40, first=0)
    return rows.select("id", F.lit(about["page"]).alias("page"))


def node_files(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by number with the metadata of the file of that number; every third file is missing."""
    docs = table(spark, d, "documents")
    files = docs.filter("doc_id % 3 != 0").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("file_size"))
    return G.with_metadata(docs.select(F.col("doc_id").alias("id")), files)


def node_maps(spark: SparkSession, d: str) -> DataFrame:
    """The whole string map of nodes made of customers; some have links, some were processed."""
    rows = table(spark, d, "customer").select(
        F.concat("c_name", F.lit(".md")).alias("file_name"), F.col("c_name").alias("metadata_id"), F.col("c_custkey").alias("file_size"), F.lit(1.5).alias("node_size"), (F.col("c_custkey") % 4).alias("hyperlink_count"),
        F.sha1(F.col("c_name").cast("binary")).alias("sha1"), F.timestamp_seconds(F.col("c_custkey") * 86400).alias("last_modified"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("https://x.org/"), "c_name")).otherwise("").alias("perplexity_link"),
        F.when(F.col("c_custkey") % 5 == 0, F.timestamp_seconds(F.lit(0))).alias("last_perplexity_process"),
    )
    built = G.node_metadata(rows)
    pairs = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return built.select("metadata_id", F.array_join(pairs, ";").alias("entries"))


def whole_graph(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of a graph that must not be empty."""
    return G.not_empty(_parts(spark, d)).select("id")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of the parts with a new price, and as many new ones."""
    some = _parts(spark, d).filter("id % 5 = 0")
    fresh = some.select((F.col("id") + 10_000_000).alias("id"), F.concat(F.lit("new "), "label").alias("label"), "weight")
    return some.select("id", F.lit(None).cast("string").alias("label"), (F.col("weight") + 1.0).alias("weight")).unionAll(fresh)


_CHANGES = """p AS (SELECT p_partkey AS id, p_name AS label, p_retailprice AS weight FROM part),
c AS (SELECT id, NULL::VARCHAR AS label, weight + CAST(1 AS DOUBLE) AS weight FROM p WHERE id % 5 = 0 UNION ALL SELECT id + 10000000, 'new ' || label, weight FROM p WHERE id % 5 = 0)"""


def node_upsert(spark: SparkSession, d: str) -> DataFrame:
    return G.upsert(_parts(spark, d), _changes(spark, d))


def node_merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_upsert(_parts(spark, d), _changes(spark, d))


def node_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    gone = _parts(spark, d).filter("id % 4 = 1").select("id")
    return G.delete_nodes(_parts(spark, d), edge_weights(spark, d), gone)[1]


def nodes_left(spark: SparkSession, d: str) -> DataFrame:
    gone = _parts(spark, d).filter("id % 4 = 1").select("id")
    return G.delete_nodes(_parts(spark, d), edge_weights(spark, d), gone)[0]


def position_carry_over(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("metadata_id"), *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")))
    new = rows.select("metadata_id", *(F.lit(0.0).alias(c) for c in "xyz"))
    return G.carried_over(new, rows.filter("metadata_id % 3 != 0"))


def position_updates(spark: SparkSession, d: str) -> DataFrame:
    """Customers as nodes at rest, their latest event as position."""
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), *(F.lit(0.0).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")), F.lit(100).alias("mass"))
    updates = table(spark, d, "events").select(
        (F.col("user_id") * 20).alias("id"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("x"), *((F.col("value") * k).alias(c) for k, c in ((2.0, "y"), (3.0, "z"), (0.1, "vx"), (0.2, "vy"), (0.3, "vz")))
    )
    return G.moved(nodes, updates)[0]


def unknown_updates(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), *(F.lit(0.0).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")))
    updates = table(spark, d, "events").select((F.col("user_id") * 20).alias("id"), "ts", F.col("event_id").alias("seq"), *(F.col("value").alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")))
    return G.moved(nodes, updates)[1].select("id", "seq")


def _commands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.array("p_brand").alias("keywords"), (F.col("p_size") > 3).alias("enabled"), F.col("p_type").alias("category")
    )


def command_search(spark: SparkSession, d: str) -> DataFrame:
    return S.command_search(_commands(spark, d), "red").select("id", "title", X.rounded("score", 6).alias("score"))


def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """The command search by an index of letter runs and letter sets."""
    found, _ = SearchIndex.build(_commands(spark, d), buckets=8).search("red")
    return found.select("id", "title", X.rounded("score", 6).alias("score"))


def stored_updates(spark: SparkSession, d: str) -> DataFrame:
    """Parts and their edges kept in buckets: some parts replaced or added, then some deleted with their edges; what is left, counted per part."""
    nodes = _parts(spark, d)
    store = GraphStore.create(nodes, edge_weights(spark, d), scratch_path(spark, "graph-store"), 8)
    store.nodes.upsert(nodes.filter("id % 10 = 3").withColumns({"id": F.when(F.col("id") % 20 == 3, F.col("id")).otherwise(-F.col("id")), "label": F.lit("changed")}))
    store.delete_nodes(nodes.filter("id % 7 = 0").select("id"))
    ends = store.by_source.rows().select(F.col("source").alias("id")).unionAll(store.by_target.rows().select(F.col("target").alias("id")))
    return store.nodes.rows().join(ends.groupBy("id").agg(F.count(F.lit(1)).alias("edges")), "id", "left").select("id", "label", F.coalesce("edges", F.lit(0)).alias("edges"))


def fuzzy_search(spark: SparkSession, d: str) -> DataFrame:
    return _commands(spark, d).select("id", X.rounded(X.fuzzy_score("rdg", F.lower("title")), 6).alias("score"))


_FUZZY = """RECURSIVE f AS (SELECT p_partkey AS id, lower(p_name) AS s, 1 AS i, 0 AS hit, 0 AS run, CAST(0 AS DOUBLE) AS score FROM part
  UNION ALL SELECT id, s, i + 1, CASE WHEN hit < 3 AND substring('{q}', hit + 1, 1) = substring(s, i, 1) THEN hit + 1 ELSE hit END,
  CASE WHEN hit < 3 AND substring('{q}', hit + 1, 1) = substring(s, i, 1) THEN run + 1 WHEN hit < 3 THEN 0 ELSE run END,
  CASE WHEN hit < 3 AND substring('{q}', hit + 1, 1) = substring(s, i, 1) THEN score + CAST(1 AS DOUBLE) + run * CAST(0.1 AS DOUBLE) ELSE score END FROM f WHERE i <= length(s)),
z AS (SELECT id, CASE WHEN hit = 3 THEN score / CAST(3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score FROM f WHERE i = length(s) + 1)"""


def help_search(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.lit(None).cast("string").alias("detail"), F.array("p_brand").alias("related"))
    return S.help_search(items, "BRAND#1").select("id", "title")


def settings_search(spark: SparkSession, d: str) -> DataFrame:
    """Ten parts to a settings group, so that a group's items are few."""
    item = F.struct(F.col("p_name").alias("key"), F.col("p_brand").alias("label"), F.lit(None).cast("string").alias("description"))
    groups = table(spark, d, "part").groupBy(F.concat_ws(" ", F.lit("group"), F.floor(F.col("p_partkey") / 10).cast("string")).alias("title")).agg(F.collect_list(item).alias("items")).withColumn("description", F.lit(None).cast("string"))
    return S.settings_search(groups, "red").select("title", F.size("items").cast("long").alias("n"))


def category_groups(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "part").groupBy(F.col("p_type").alias("category")).agg(F.min(F.when(F.col("p_type") != "ECONOMY", F.col("p_size"))).alias("priority"))
    return S.by_category(_commands(spark, d), sizes).withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


def category_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.in_category(_commands(spark, d), "SMALL").select("id", "title")


def _users(spark: SparkSession, d: str) -> DataFrame:
    segment, key = F.col("c_mktsegment"), F.col("c_custkey")
    roles = F.filter(
        F.array(F.when(segment == "BUILDING", "perplexity"), F.when(key % 2 == 0, "openai"), F.when(key % 3 == 0, "ragflow"), F.when(segment == "MACHINERY", "settings_sync"), F.when(key % 11 == 0, "power")),
        lambda x: x.isNotNull(),
    )
    return table(spark, d, "customer").select(F.col("c_name").alias("pubkey"), roles.alias("roles"), (key % 11 == 0).alias("is_power_user"), F.when(key % 4 != 0, F.concat(F.lit("key-"), "c_name")).alias("api_key"))


def rbac_features(spark: SparkSession, d: str) -> DataFrame:
    users = A.has_feature(A.with_features(_users(spark, d)), "settings_sync")
    return users.select("pubkey", F.array_join("features", ",").alias("features"), "allowed")


def register_users(spark: SparkSession, d: str) -> DataFrame:
    users = _users(spark, d)
    lists = users.filter("size(roles) > 0").select(F.explode("roles").alias("list_name"), "pubkey").unionAll(users.filter("is_power_user").select(F.lit("approved").alias("list_name"), "pubkey"))
    return A.registered(lists, users)


def api_key_resolution(spark: SparkSession, d: str) -> DataFrame:
    users = _users(spark, d).filter("pubkey NOT LIKE '%5'")
    return A.resolved_keys(_users(spark, d).select("pubkey"), users, "shared").select("pubkey", "key")


def key_update_status(spark: SparkSession, d: str) -> DataFrame:
    users = _users(spark, d).filter("pubkey NOT LIKE '%5'")
    return A.key_update_status(_users(spark, d).select("pubkey"), users).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


CATALOG = {
    "edge_weights": (edge_weights, f"WITH {_EDGES} SELECT id, source, target, weight FROM w"),
    "graph_health": (graph_health, f"WITH {_EDGES} SELECT 'metadata' AS name, count(*) AS n FROM documents UNION ALL SELECT 'nodes', count(*) FROM part UNION ALL SELECT 'edges', count(*) FROM w"),
    "graph_page": (graph_page, "SELECT p_partkey AS id, p_name AS label, (SELECT count(*) FROM part) AS total, CAST(ceil((SELECT count(*) FROM part) / 75.0) AS BIGINT) AS total_pages FROM part ORDER BY p_partkey LIMIT 75 OFFSET 75"),
    "graph_page_edges": (graph_page_edges, f"WITH {_EDGES}, p AS (SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 75 OFFSET 75) SELECT id, source, target, weight FROM w WHERE source IN (SELECT * FROM p) OR target IN (SELECT * FROM p)"),
    "first_pages": (first_pages, "SELECT p_partkey AS id, 2 AS page FROM part ORDER BY p_partkey LIMIT 40 OFFSET 80"),
    "node_files": (node_files, "SELECT doc_id AS id, CASE WHEN doc_id % 3 <> 0 THEN strlen(coalesce(text, '')) END AS file_size FROM documents"),
    "node_maps": (node_maps, """SELECT c_name AS metadata_id, array_to_string(list_sort(list_filter(['fileName=' || c_name || '.md', 'name=' || c_name, 'metadataId=' || c_name, 'fileSize=' || c_custkey, 'nodeSize=1.5',
      'hyperlinkCount=' || c_custkey % 4, 'sha1=' || sha1(c_name), 'lastModified=' || strftime(make_timestamp(c_custkey * 86400000000), '%Y-%m-%dT%H:%M:%SZ'),
      CASE WHEN c_custkey % 3 = 0 THEN 'perplexityLink=https://x.org/' || c_name END, CASE WHEN c_custkey % 5 = 0 THEN 'lastPerplexityProcess=1970-01-01T00:00:00Z' END], lambda e: e IS NOT NULL)), ';') AS entries FROM customer"""),
    "whole_graph": (whole_graph, "SELECT p_partkey AS id FROM part"),
    "node_upsert": (node_upsert, f"WITH {_CHANGES} SELECT * FROM p WHERE id NOT IN (SELECT id FROM c) UNION ALL SELECT * FROM c"),
    "node_merge_upsert": (node_merge_upsert, f"WITH {_CHANGES} SELECT id, coalesce(c.label, p.label) AS label, coalesce(c.weight, p.weight) AS weight FROM p FULL JOIN c USING (id)"),
    "node_delete_cascade": (node_delete_cascade, f"WITH {_EDGES} SELECT id, source, target, weight FROM w WHERE source % 4 <> 1 AND target % 4 <> 1"),
    "nodes_left": (nodes_left, "SELECT p_partkey AS id, p_name AS label, p_retailprice AS weight FROM part WHERE p_partkey % 4 <> 1"),
    "position_carry_over": (position_carry_over, "SELECT vec_id AS metadata_id, " + ", ".join(f"CASE WHEN vec_id % 3 <> 0 THEN CAST(embedding[{i}] AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS {c}" for i, c in enumerate("xyz", 1)) + " FROM embeddings"),
    "position_updates": (position_updates, """WITH u AS (SELECT user_id * 20 AS id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
      SELECT c_custkey AS id, coalesce(value, CAST(0 AS DOUBLE)) AS x, coalesce(value * CAST(2 AS DOUBLE), CAST(0 AS DOUBLE)) AS y, coalesce(value * CAST(3 AS DOUBLE), CAST(0 AS DOUBLE)) AS z,
      coalesce(value * CAST(0.1 AS DOUBLE), CAST(0 AS DOUBLE)) AS vx, coalesce(value * CAST(0.2 AS DOUBLE), CAST(0 AS DOUBLE)) AS vy, coalesce(value * CAST(0.3 AS DOUBLE), CAST(0 AS DOUBLE)) AS vz, 100 AS mass
      FROM customer LEFT JOIN u ON u.id = c_custkey AND r = 1"""),
    "unknown_updates": (unknown_updates, "SELECT user_id * 20 AS id, event_id AS seq FROM events WHERE user_id * 20 NOT IN (SELECT c_custkey FROM customer)"),
    "command_search": (command_search, f"""WITH {_FUZZY.format(q='red')} SELECT p_partkey AS id, p_name AS title, round(s, 6) AS score FROM (
      SELECT p.*, CASE WHEN lower(p_name) = 'red' THEN CAST(1 AS DOUBLE) WHEN starts_with(lower(p_name), 'red') THEN 0.8 WHEN contains(lower(p_name), 'red') THEN 0.6
      WHEN contains(lower(p_type), 'red') THEN 0.4 WHEN contains(lower(p_brand), 'red') THEN 0.3 ELSE z.score END AS s FROM part p JOIN z ON z.id = p.p_partkey WHERE p_size > 3) WHERE s > 0.3"""),
    "indexed_search": (indexed_search, f"""WITH {_FUZZY.format(q='red')} SELECT p_partkey AS id, p_name AS title, round(s, 6) AS score FROM (
      SELECT p.*, CASE WHEN lower(p_name) = 'red' THEN CAST(1 AS DOUBLE) WHEN starts_with(lower(p_name), 'red') THEN 0.8 WHEN contains(lower(p_name), 'red') THEN 0.6
      WHEN contains(lower(p_type), 'red') THEN 0.4 WHEN contains(lower(p_brand), 'red') THEN 0.3 ELSE z.score END AS s FROM part p JOIN z ON z.id = p.p_partkey WHERE p_size > 3) WHERE s > 0.3"""),
    "stored_updates": (stored_updates, f"""WITH {_EDGES}, n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 20 = 3 THEN 'changed' ELSE p_name END AS label FROM part WHERE p_partkey % 7 <> 0
        UNION ALL SELECT -p_partkey, 'changed' FROM part WHERE p_partkey % 20 = 13),
      k AS (SELECT source, target FROM w WHERE source % 7 <> 0 AND target % 7 <> 0), x AS (SELECT source AS id FROM k UNION ALL SELECT target FROM k), c AS (SELECT id, count(*) AS edges FROM x GROUP BY id)
      SELECT n.id, n.label, coalesce(c.edges, 0) AS edges FROM n LEFT JOIN c ON c.id = n.id"""),
    "fuzzy_search": (fuzzy_search, f"WITH {_FUZZY.format(q='rdg')} SELECT id, round(score, 6) AS score FROM z"),
    "help_search": (help_search, "SELECT p_partkey AS id, p_name AS title FROM part WHERE contains(lower(p_name), 'brand#1') OR contains(lower(p_type), 'brand#1') OR contains(lower(p_brand), 'brand#1')"),
    "settings_search": (settings_search, "SELECT 'group ' || p_partkey // 10 AS title, count(*) AS n FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') GROUP BY 1"),
    "category_groups": (category_groups, "SELECT p_type AS category, CASE WHEN p_type <> 'ECONOMY' THEN min(p_size) ELSE 0 END AS priority, count(*) AS n, min(p_name) AS first_title, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS ids FROM part GROUP BY p_type"),
    "category_filter": (category_filter, "SELECT p_partkey AS id, p_name AS title FROM part WHERE p_type = 'SMALL'"),
    "rbac_features": (rbac_features, """SELECT c_name AS pubkey, concat_ws(',', CASE WHEN c_mktsegment = 'BUILDING' THEN 'perplexity' END, CASE WHEN c_custkey % 2 = 0 THEN 'openai' END,
      CASE WHEN c_custkey % 3 = 0 THEN 'ragflow' END, CASE WHEN c_mktsegment = 'MACHINERY' OR c_custkey % 11 = 0 THEN 'settings_sync' END, CASE WHEN c_custkey % 11 = 0 THEN 'power_user' END) AS features,
      c_mktsegment = 'MACHINERY' OR c_custkey % 11 = 0 AS allowed FROM customer"""),
    "register_users": (register_users, """WITH l AS (SELECT 'perplexity' AS list_name, c_name AS pubkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT 'openai', c_name FROM customer WHERE c_custkey % 2 = 0
      UNION SELECT 'ragflow', c_name FROM customer WHERE c_custkey % 3 = 0 UNION SELECT 'settings_sync', c_name FROM customer WHERE c_mktsegment = 'MACHINERY'
      UNION SELECT 'power', c_name FROM customer WHERE c_custkey % 11 = 0 UNION SELECT 'approved', c_name FROM customer WHERE c_custkey % 11 = 0)
      SELECT * FROM l UNION SELECT unnest(['approved', 'ragflow', 'openai']), c_name FROM customer WHERE c_custkey % 11 <> 0"""),
    "api_key_resolution": (api_key_resolution, """SELECT c_name AS pubkey, CASE WHEN c_name LIKE '%5' THEN NULL WHEN c_custkey % 11 = 0 THEN 'shared' WHEN c_custkey % 4 <> 0 THEN 'key-' || c_name END AS key FROM customer"""),
    "key_update_status": (key_update_status, "SELECT CASE WHEN c_name LIKE '%5' THEN 'unknown' WHEN c_custkey % 11 = 0 THEN 'power_user' ELSE 'accepted' END AS status, count(*) AS n FROM customer GROUP BY 1"),
}
