"""Nodes and edges: construction, paging, updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import exprs as X
from loomgraph.operators.paging import PageIndex
from loomgraph.operators.ranking import numbered
from loomgraph.sources.tables import spread


def undirected_edges(counts: DataFrame, source: str = "source", target: str = "target", weight: str = "weight", rows: int | None = None) -> DataFrame:
    """(id, source, target, weight): both directions of a pair summed under (least, greatest); no self-loops.

    With the number of rows of counts, if it is known, the pairs are dealt so that a task's share stays the same as they grow.
    """
    pairs = counts.filter(F.col(source) != F.col(target))
    low, high = F.least(source, target).alias("source"), F.greatest(source, target).alias("target")
    pairs = pairs.select(low, high, F.col(weight).alias("weight"))
    summed = (pairs if rows is None else spread(pairs, rows, "source", "target")).groupBy("source", "target").agg(F.sum("weight").alias("weight"))
    return summed.select(X.edge_id(F.col("source"), F.col("target")).alias("id"), "source", "target", "weight")


def resolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between names as edges between node ids; edges with an unknown end drop out."""
    source = nodes.select(F.col("metadata_id").alias("source_name"), F.col("id").alias("source"))
    target = nodes.select(F.col("metadata_id").alias("target_name"), F.col("id").alias("target"))
    return edges.join(source, "source_name").join(target, "target_name").select("source", "target", "weight")


def node_metadata(nodes: DataFrame) -> DataFrame:
    """nodes with their string map: ten fixed entries, without those that are null, and without an empty link."""
    entries = {
        "fileName": F.col("file_name"),
        "name": X.stem_once(F.col("file_name")),
        "metadataId": F.col("metadata_id"),
        "fileSize": F.col("file_size").cast("string"),
        "nodeSize": F.col("node_size").cast("string"),
        "hyperlinkCount": F.col("hyperlink_count").cast("string"),
        "sha1": F.col("sha1"),
        "lastModified": F.date_format("last_modified", "yyyy-MM-dd'T'HH:mm:ssXXX"),
    }
    if "perplexity_link" in nodes.columns:
        entries["perplexityLink"] = F.when(F.col("perplexity_link") != "", F.col("perplexity_link"))
    if "last_perplexity_process" in nodes.columns:
        entries["lastPerplexityProcess"] = F.date_format("last_perplexity_process", "yyyy-MM-dd'T'HH:mm:ssXXX")
    built = F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)])
    return nodes.withColumn("metadata", F.map_filter(built, lambda _, v: v.isNotNull()))


def page(nodes: DataFrame, number: int, page_size: int = 100, order: str = "id", first: int = 1) -> tuple[DataFrame, dict]:
    """One page of nodes without an index at hand; whoever reads more than one page keeps the PageIndex."""
    return PageIndex.build(nodes, order).page(number, page_size, first)


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with at least one end among ids, by two semi-joins instead of an OR condition."""
    ids = ids.select(F.col("id").alias("_id")).distinct()
    from_page = edges.join(ids, edges["source"] == ids["_id"], "left_semi")
    rest = edges.join(ids, edges["source"] == ids["_id"], "left_anti")
    return from_page.unionAll(rest.join(ids, rest["target"] == ids["_id"], "left_semi"))


def upsert(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows replaced or added by key."""
    return rows.join(changes, key, "left_anti").unionByName(changes)


def merge_upsert(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows merged field by field: values of changes win where they are present."""
    new = changes.select(F.col(key), *(F.col(c).alias(f"_new_{c}") for c in rows.columns if c != key))
    joined = rows.join(new, key, "full_outer")
    return joined.select(key, *(F.coalesce(f"_new_{c}", c).alias(c) for c in rows.columns if c != key))


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without the ids in gone, and edges without those that touch them."""
    gone = gone.select(F.col("id").alias("_id")).distinct()
    left = edges.join(gone, edges["source"] == gone["_id"], "left_anti")
    return nodes.join(gone, nodes["id"] == gone["_id"], "left_anti"), left.join(gone, left["target"] == gone["_id"], "left_anti")


def carried_over(new: DataFrame, old: DataFrame, key: str = "metadata_id") -> DataFrame:
    """New nodes with the old positions of the same key where there are any."""
    kept = old.select(key, *(F.col(c).alias(f"_old_{c}") for c in "xyz"))
    joined = new.join(kept, key, "left")
    return joined.select(*(F.coalesce(f"_old_{c}", c).alias(c) if c in "xyz" else F.col(c) for c in new.columns))


def moved(nodes: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes at their latest update's position and velocity, updates of unknown ids)."""
    motion = ["x", "y", "z", "vx", "vy", "vz"]
    latest = updates.groupBy("id").agg(F.max_by(F.struct(*motion), F.struct("ts", "seq")).alias("u"))
    joined = nodes.join(latest, "id", "left")
    placed = joined.select(*(F.coalesce(F.col("u")[c], F.col(c)).alias(c) if c in motion else F.col(c) for c in nodes.columns))
    return placed, updates.join(nodes, "id", "left_anti")


def health(**tables: DataFrame) -> DataFrame:
    """(name, rows) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def not_empty(nodes: DataFrame, least: int = 1) -> DataFrame:
    """nodes, or an error if there are fewer than least."""
    if nodes.limit(least).count() < least:
        raise ValueError(f"the graph has fewer than {least} nodes")
    return nodes


def with_metadata(nodes: DataFrame, metadata: DataFrame) -> DataFrame:
    """nodes (id) with the metadata of the file named after their id, null where there is none."""
    named = metadata.withColumnRenamed("file_name", "_file")
    return nodes.join(named, F.concat(F.col("id").cast("string"), F.lit(".md")) == F.col("_file"), "left").drop("_file")


def coloured(users: DataFrame, local: int | None = None, order: str = "id") -> DataFrame:
    """users with the colour of their place in order, five colours in turn; the local user is left out."""
    # Fixed values of the palette.
    colours = F.array(*map(F.lit, ["#ff0000", "#00ff00", "#0000ff", "#ffff00", "#ff00ff"]))
    rows = numbered(users, order, name="_row")
    shown = rows if local is None else rows.filter(F.col(order) != local)
    return shown.withColumn("colour", F.element_at(colours, (F.col("_row") % 5 + 1).cast("int"))).drop("_row")


def moving_share(nodes: DataFrame, least: float = 0.001) -> DataFrame:
    """(moving, total, fraction): nodes of which a velocity component exceeds least."""
    fast = F.greatest(*(F.abs(F.col(c)) for c in ("vx", "vy", "vz"))) > least
    counted = nodes.agg(F.count_if(fast).alias("moving"), F.count(F.lit(1)).alias("total"))
    return counted.withColumn("fraction", F.when(F.col("total") > 0, F.col("moving") / F.col("total")).otherwise(0.0))
