"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import checkpointed


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One round over pairs (u, v), u > v; the least neighbour of each node becomes its hub.

    Minima combine map-side and the join back is an ordinary equi-join that adaptive execution
    may split, so a hub with very many links costs no task more than its share.
    """
    both = pairs.select(F.col("u").alias("n"), F.col("v").alias("o"))
    if large:
        both = both.unionAll(pairs.select(F.col("v").alias("n"), F.col("u").alias("o")))
    hubs = both.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("m"))
    joined = both.join(hubs, "n")
    if large:
        moved = joined.filter("o > n").select(F.col("o").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("o").alias("u"), F.col("m").alias("v")).unionAll(hubs.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return moved.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id of links with a smaller id in its component.

    component is the least reachable id; ids that are least themselves, or that have no link, have no row. Each
    round is checkpointed in the shared folder; the number of rounds grows with the logarithm
    of the largest component.
    """
    pairs = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs, before = checkpointed(pairs), None
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    while True:
        now = pairs.agg(mark).first()[0]
        if now == before or now[0] == 0:
            return pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now
        pairs = checkpointed(_star(_star(pairs, large=True), large=False))
