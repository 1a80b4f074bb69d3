"""Tables that are changed in place: rows in buckets by id, of which a change rewrites only those it touches."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.sources.tables import TASK_ROWS, discarded, settled, shuffles_removed

#: Rows that are written in one go, about: what they need aside and in the shuffle is bounded thereby. A bucket is never parted.
MOST_ROWS = 1 << 25
#: A store is filled in goes of this many times as many rows, since each reads the whole table.
_FILL = 8


@dataclass
class BucketStore:
    """A folder of Parquet files, one directory per bucket of key. The bucket is a hash, so hot ids don't crowd one."""

    spark: SparkSession
    path: str
    key: str
    buckets: int
    schema: T.StructType

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str = "id", buckets: int = 64) -> BucketStore:
        """Write rows for the first time; upsert, merge and delete need unique keys."""
        with shuffles_removed(rows.sparkSession):
            aside = settled(rows, "store-new", compression="zstd")  # counted before they are dealt
        store = cls(rows.sparkSession, path, key, buckets, rows.schema)
        store._fill(aside, aside.count())
        discarded(aside)
        return store

    def _fill(self, rows: DataFrame, count: int) -> None:
        """The first rows, of a stored table, which is read again for each of a few groups of buckets."""
        passes = max(1, min(-(-count // (_FILL * MOST_ROWS)), self.buckets))
        for k in range(passes):
            some = range(k, self.buckets, passes)
            self._write(rows.filter(self.bucket().isin(*some)) if passes > 1 else rows, count // passes, len(some), "append" if k else None)

    def bucket(self, of: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key) if of is None else of), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, count: int, buckets: int, mode: str | None) -> None:
        """Each bucket by one task, or in several files by more of them where it has more rows than a task should sort; count: all rows, about."""
        files = -(-count // (buckets * TASK_ROWS))
        dealt = rows.select(*self.schema.names, self.bucket().alias("_bucket"))
        if files > 1:
            hashed = [f.name for f in self.schema if not {"map", "variant"} & set(re.findall(r"\w+", f.dataType.simpleString()))]
            dealt = dealt.repartition(buckets * files, "_bucket", F.pmod(F.xxhash64(*hashed), F.lit(files)))
        else:
            dealt = dealt.repartition(buckets, "_bucket")
        writer = dealt.write.partitionBy("_bucket").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        with shuffles_removed(self.spark):
            (writer.mode(mode) if mode else writer).parquet(self.path)

    def _stored(self, buckets: list[int] | None) -> DataFrame:
        kept = T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])
        found = self.spark.read.schema(kept).parquet(self.path)
        return found if buckets is None else found.filter(F.col("_bucket").isin(buckets))

    def _files(self, buckets: list[int]) -> dict[int, dict[str, int]]:
        """The files of some buckets that have rows, and how many."""
        out: dict[int, dict[str, int]] = {}
        for b, name, n in self._stored(buckets).groupBy("_bucket", F.input_file_name()).count().collect():
            out.setdefault(b, {})[name] = n
        return out

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, whose directories alone are listed."""
        return self._stored(buckets).drop("_bucket")

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of some keys: at most as many as there are."""
        with shuffles_removed(self.spark):
            return sorted(r[0] for r in keys.select(self.bucket(F.col(self.key).cast(self.schema[self.key].dataType)).alias("b")).distinct().collect())

    def _replace(self, change: Callable[[DataFrame, Callable[[DataFrame], DataFrame]], DataFrame], buckets: list[int], more: int = 0) -> None:
        """New contents of whole buckets: what change makes of their rows and of those changes that belong to them, about `more` in all.

        Spark keeps a job's files aside until it ends and exchanges the buckets' directories then, so rows may be computed from the old ones.
        Buckets are taken in groups of about MOST_ROWS rows.
        """
        before = self._files(buckets)
        groups: list[tuple[list[int], int]] = []
        for b in buckets:
            rows = sum(before.get(b, {}).values()) + more // len(buckets)
            if groups and groups[-1][1] + rows <= MOST_ROWS:
                groups[-1] = [*groups[-1][0], b], groups[-1][1] + rows
            else:
                groups.append(([b], rows))
        for some, rows in groups:
            theirs = lambda changes, some=some: changes.filter(self.bucket().isin(some))
            self._write(change(self.rows(some), theirs), rows, len(some), "overwrite")
        for b, left in self._files(buckets).items():
            if left.keys() & before.get(b, {}).keys():  # a bucket that lost all its rows was not written
                self.spark.createDataFrame([], self.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_bucket={b}")

    def upsert(self, changes: DataFrame) -> list[int]:
        """Rows replaced or added by key; returns the buckets that were rewritten. Of changes with one key any one is taken."""
        with shuffles_removed(self.spark):
            changes = settled(changes.select(*self.schema.names).dropDuplicates([self.key]), "store-upsert")
        buckets = self.touched(changes)
        if buckets:
            self._replace(lambda old, own: old.join(changes.select(self.key), self.key, "left_anti").unionByName(own(changes)), buckets, changes.count())
        discarded(changes)
        return buckets

    def merge(self, changes: DataFrame) -> list[int]:
        """Rows merged field by field: what changes hold wins where it is not null; new keys are added."""
        with shuffles_removed(self.spark):
            changes = settled(changes.select(*self.schema.names).dropDuplicates([self.key]), "store-merge")
        buckets = self.touched(changes)
        if buckets:
            new = [self.key, *(F.col(c).alias(f"_new_{c}") for c in self.schema.names if c != self.key)]
            both = [F.coalesce(f"_new_{c}", c).alias(c) if c != self.key else c for c in self.schema.names]
            self._replace(lambda old, own: old.join(own(changes).select(*new), self.key, "full_outer").select(*both), buckets, changes.count())
        discarded(changes)
        return buckets

    def delete(self, keys: DataFrame) -> list[int]:
        """Rows without those of some keys."""
        with shuffles_removed(self.spark):
            keys = settled(keys.select(self.key).distinct(), "store-delete")
        buckets = self.touched(keys)
        if buckets:
            self._replace(lambda old, own: old.join(own(keys), self.key, "left_anti"), buckets)
        discarded(keys)
        return buckets


@dataclass
class GraphStore:
    """Nodes in buckets by id; edges twice, in buckets by their source and by their target, so that a node's edges are found on both sides."""

    nodes: BucketStore
    by_source: BucketStore
    by_target: BucketStore

    @classmethod
    def create(cls, nodes: DataFrame, edges: DataFrame, path: str, buckets: int = 64) -> GraphStore:
        """nodes: id and more, ids unique; edges: source, target and more."""
        by_source = BucketStore.create(edges, f"{path}/by_source", "source", buckets)
        kept = by_source.rows()
        by_target = BucketStore(edges.sparkSession, f"{path}/by_target", "target", buckets, edges.schema)
        by_target._fill(kept, kept.count())
        return cls(BucketStore.create(nodes, f"{path}/nodes", "id", buckets), by_source, by_target)

    def delete_nodes(self, ids: DataFrame) -> dict[str, list[int]]:
        """Nodes and all edges that touch them; only buckets of their ids and of their neighbours' are rewritten."""
        with shuffles_removed(ids.sparkSession):
            ids = settled(ids.select("id").distinct(), "store-gone")
        # the other copy of an edge lies in the bucket of its other end
        near = {}
        for store, other, end, far in ((self.by_source, self.by_target, "source", "target"), (self.by_target, self.by_source, "target", "source")):
            gone = ids.withColumnRenamed("id", end)
            own = store.touched(gone)
            near[far] = other.touched(store.rows(own).join(gone, end, "left_semi").select(far)) if own else []
        done = {"nodes": self.nodes.delete(ids)}
        for store, end, far, name in ((self.by_source, "source", "target", "by_source"), (self.by_target, "target", "source", "by_target")):
            gone, beyond = (ids.withColumnRenamed("id", c) for c in (end, far))
            buckets = sorted({*store.touched(gone), *near[end]})
            if buckets:
                store._replace(lambda old, own, store=store, end=end, far=far, gone=gone, beyond=beyond: old.join(own(gone), end, "left_anti").join(beyond, far, "left_anti").select(*store.schema.names), buckets)
            done[name] = buckets
        discarded(ids)
        return done
