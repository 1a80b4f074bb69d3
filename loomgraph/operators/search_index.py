"""Search by an index: runs of letters lead to the rows that can contain a query, sets of letters to those it can be a subsequence of."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.search import command_search
from loomgraph.sources.stores import BucketStore
from loomgraph.sources.tables import scratch_path, settled

#: Longest runs of letters that are indexed; shorter queries are looked up by a run of their own length.
RUN = 3
#: Bits of a set of letters.
_BITS = 63


def runs(text: Column) -> Column:
    """All different runs of 1 to RUN letters."""
    n = F.length(text)
    at = lambda size: F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(at(size) for size in range(1, RUN + 1))))


def letters(text: Column) -> Column:
    """The set of letters as bits; different letters may share one, so that a set never misses a letter."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % _BITS)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(bit(c)))


@dataclass
class SearchIndex:
    """Commands (id unique, title, description, keywords, enabled) in buckets by id; runs of letters with their ids in buckets by run."""

    rows: BucketStore
    runs: BucketStore
    masks: DataFrame

    @classmethod
    def build(cls, commands: DataFrame, path: str | None = None, buckets: int = 64) -> SearchIndex:
        path = path or scratch_path(commands.sparkSession, "search")
        rows = BucketStore.create(commands, f"{path}/rows", "id", buckets)
        low = lambda c: F.lower(F.coalesce(c, F.lit("")))
        words = F.transform(F.coalesce("keywords", F.array().cast("array<string>")), low)
        texts = F.concat(F.array(low(F.col("title")), low(F.col("description"))), words)
        postings = rows.rows().select("id", F.explode(F.array_distinct(F.flatten(F.transform(texts, runs)))).alias("run"))
        found = BucketStore.create(postings, f"{path}/runs", "run", buckets)
        masks = settled(rows.rows().select("id", letters(low(F.col("title"))).alias("mask")), "search-letters")
        return cls(rows, found, masks)

    def candidates(self, query: str) -> DataFrame:
        """Ids of the rows that can have a score: those with all runs of the query in their texts, and those whose title has all its letters."""
        q = query.lower()
        wanted = sorted({q[i : i + RUN] for i in range(max(1, len(q) - RUN + 1))})
        spark = self.masks.sparkSession
        near = self.runs.rows(self.runs.touched(spark.createDataFrame([(w,) for w in wanted], "run string"))).filter(F.col("run").isin(wanted))
        holding = near.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).select("id")
        bits = 0
        for c in q:
            bits |= 1 << ord(c) % _BITS
        return holding.unionAll(self.masks.filter(F.col("mask").bitwiseAND(F.lit(bits)) == bits).select("id")).distinct()

    def search(self, query: str, threshold: float = 0.3) -> tuple[DataFrame, int]:
        """(what command_search gives over all rows, rows that were scored); threshold must not be negative."""
        if threshold < 0:
            raise ValueError("threshold must not be negative")
        if not query.strip():
            return command_search(self.rows.rows(), query, threshold), -1
        ids = settled(self.candidates(query), "search-candidates")
        scored = self.rows.rows(self.rows.touched(ids)).join(ids, "id", "left_semi")
        return command_search(scored, query, threshold), ids.count()
