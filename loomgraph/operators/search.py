"""Ranked and fuzzy search over titles, descriptions and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import exprs as X


def command_search(commands: DataFrame, query: str, threshold: float = 0.3) -> DataFrame:
    """Enabled commands (id, title, description, keywords, enabled) with their score, best first.

    1 for the title itself, 0.8 for its beginning, 0.6 for a part of it, 0.4 for the description,
    0.3 for a keyword, else the fuzzy score; only scores above threshold. A blank query finds all.
    """
    enabled = commands.filter(F.coalesce("enabled", F.lit(True)))
    if not query.strip():
        return enabled.withColumn("score", F.lit(1.0))
    q = query.lower()
    title = F.lower("title")
    score = (
        F.when(title == q, 1.0)
        .when(title.startswith(q), 0.8)
        .when(title.contains(q), 0.6)
        .when(F.lower("description").contains(q), 0.4)
        .when(F.exists("keywords", lambda k: F.lower(k).contains(q)), 0.3)
        .otherwise(X.fuzzy_score(q, title))
    )
    return enabled.withColumn("score", score).filter(F.col("score") > threshold).orderBy(F.desc("score"), "title", "id")


def help_search(items: DataFrame, query: str) -> DataFrame:
    """Items (title, description, detail, related) that contain the query anywhere, ignoring case."""
    q = query.lower()
    fields = [F.coalesce(F.lower(c).contains(q), F.lit(False)) for c in ("title", "description", "detail")]
    related = F.coalesce(F.exists("related", lambda r: F.lower(r).contains(q)), F.lit(False))
    return items.filter(fields[0] | fields[1] | fields[2] | related)


def settings_search(groups: DataFrame, query: str) -> DataFrame:
    """Groups (title, description, items) with the items that match by themselves or by their group; no empty groups."""
    if not query.strip():
        return groups
    q = query.lower()
    has = lambda c: F.coalesce(F.lower(c).contains(q), F.lit(False))
    whole = has(F.col("title")) | has(F.col("description"))
    kept = F.filter("items", lambda i: whole | has(i["key"]) | has(i["label"]) | has(i["description"]))
    return groups.withColumn("items", kept).filter(F.size("items") > 0)


def in_category(items: DataFrame, category: str) -> DataFrame:
    return items.filter(F.col("category") == category)


def by_category(items: DataFrame, priorities: DataFrame) -> DataFrame:
    """(category, priority, n, first title, ids) ordered by priority, 0 where it is missing; a category's items are those of a menu."""
    grouped = items.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("first_title"), F.array_sort(F.collect_list("id")).alias("ids"))
    ranked = grouped.join(priorities, "category", "left").withColumn("priority", F.coalesce("priority", F.lit(0)))
    return ranked.orderBy("priority", "category")


def recent(uses: DataFrame, most: int = 10) -> DataFrame:
    """The most recently used ids, each once, latest first."""
    last = uses.groupBy("id").agg(F.max(F.struct("ts", "seq")).alias("last"))
    return last.orderBy(F.desc("last")).limit(most).select("id", F.col("last.ts").alias("ts"))
