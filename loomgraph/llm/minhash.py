"""Operator 3: near duplicates by MinHash with tensored banding, links confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from loomgraph.llm.common import looked_up, small_batches, table, written
from loomgraph.llm.components import components
from loomgraph.llm.shingles import SHINGLE_WORDS, mix, shingle_sets

#: Two collections of SIDE half keys with HALF minhashes each. A table key joins a half key of
#: either collection: SIDE * SIDE tables of 2 * HALF minhashes from 2 * SIDE * HALF minhashes
#: (48 instead of 576). A pair with similarity 0.75 shares no table with probability 1e-4.
SIDE, HALF = 12, 2
PERCENT = 75


def _features(docs: DataFrame, words: int, side: int, half: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, halves) per row; set_key stands for the whole set."""
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("n_shingles", T.LongType()),
            T.StructField("set_key", T.ArrayType(T.LongType())),
            T.StructField("halves", T.ArrayType(T.LongType())),
        ]
    )
    factors = np.random.default_rng(3).integers(1, 1 << 63, 2 * side * half, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, hashes, offsets in shingle_sets(batch.column("text"), words):
                rows = len(offsets) - 1
                n = np.diff(offsets)
                full = np.flatnonzero(n)
                at = offsets[:-1][full]
                keys = np.zeros((rows, 2), np.uint64)
                halves = np.zeros((rows, 2 * side), np.uint64)
                if len(full):
                    keys[full, 0] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), at)
                    keys[full, 1] = np.add.reduceat(mix(hashes * np.uint64(0xDA942042E4DD58B5)), at)
                    for j in range(2 * side):
                        key = np.full(len(full), j + 1, dtype=np.uint64)
                        for factor in factors[j * half : (j + 1) * half]:
                            key = mix(key * np.uint64(31) + np.minimum.reduceat(hashes * factor, at))
                        halves[full, j] = key
                flat = pa.array(halves.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, rows),
                        pa.array(n.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * rows + 1, 2, dtype=np.int32)), pa.array(keys.view(np.int64).ravel())),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * side * rows + 1, 2 * side, dtype=np.int32)), flat),
                    ],
                    ["doc_id", "n_shingles", "set_key", "halves"],
                )

    return small_batches(docs).mapInArrow(run, schema)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, sh): the whole shingle set of each row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("sh", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, hashes, offsets in shingle_sets(batch.column("text"), words):
                values = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(offsets) - 1), values], ["doc_id", "sh"])

    return small_batches(docs).mapInArrow(run, schema)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have a similarity of at least percent."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("sh").alias("sh_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("sh").alias("sh_b"))
    both = F.size(F.array_intersect("sh_a", "sh_b"))
    small, large = F.least(F.size("sh_a"), F.size("sh_b")), F.greatest(F.size("sh_a"), F.size("sh_b"))
    joined = pairs.join(left, "a").join(right, "b").filter(small * 100 >= large * percent)
    return joined.filter(both * 100 >= (F.size("sh_a") + F.size("sh_b") - both) * percent).select("a", "b")


def _cross_pairs(contested: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different components that can be links, exactly, without listing groups.

    Shingles are ordered rarest first. A link of x (not smaller) and y shares a shingle of x's
    first n - ceil(t n) + 1 and y's first n - ceil(2 t / (1 + t) n) + 1, and at the first one
    shared, enough shingles must remain in both. Shingles of one document alone drop out.
    contested: (doc_id, component, sh).
    """
    t = percent / 100
    rows = contested.select("doc_id", "component", F.size("sh").alias("n"), F.explode("sh").alias("s"))
    df = rows.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    order = W.partitionBy("doc_id").orderBy("df", "s")  # a document's own shingles
    ranked = rows.join(df, "s").withColumn("pos", F.row_number().over(order) - 1)
    n, eps = F.col("n"), 1e-9
    prefix = ranked.filter((F.col("pos") < n - F.ceil(n * t - eps) + 1) & (F.col("df") > 1))
    index = prefix.filter(F.col("pos") < n - F.ceil(n * (2 * t / (1 + t)) - eps) + 1)
    x = prefix.select("s", *(F.col(c).alias(f"{c}_x") for c in ("doc_id", "component", "n", "pos")))
    y = index.select("s", *(F.col(c).alias(f"{c}_y") for c in ("doc_id", "component", "n", "pos")))
    rest = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y"))
    able = (
        (F.col("component_x") != F.col("component_y"))
        & ((F.col("n_x") > F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("doc_id_x") != F.col("doc_id_y"))))
        & (F.col("n_y") * 100 >= F.col("n_x") * percent)
        & (rest * (100 + percent) >= (F.col("n_x") + F.col("n_y")) * percent)
    )
    joined = x.join(y, (x["s"] == y["s"]) & able)
    return joined.select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b")).distinct()


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = PERCENT,
    words: int = SHINGLE_WORDS,
    side: int = SIDE,
    half: int = HALF,
) -> DataFrame:
    """Group documents linked by word-shingle similarity >= percent / 100; the least id stays.

    Returns one row per input row: id_col, n_shingles, component_id, kept.

    Documents with equal sets are one representative. Half keys that occur once are dropped
    before they are combined, without loss, so only documents with a shared half key in both
    collections make table keys. Counts and hubs of half keys and buckets combine before the shuffle and are joined back, so that a
    crowded one can be split. In each bucket all members are first compared with the one
    that shares the most half keys; whole sets decide. What then still lies in one bucket but in different components is
    compared completely by a prefix-filtered join, so no bucket is capped or listed pair by pair.

    Defined cases: words are runs of non-white-space, A-Z lowered; null, empty or blank texts have
    no shingle and are linked with nothing; texts of any length are hashed whole; a null id is
    its own component (component_id null, kept true); rows that repeat an id are one document with the union of links; an
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    features = written(_features(docs, words, side, half), "near-features")
    usable = features.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = written(
        usable.groupBy("n_shingles", "set_key").agg(F.min("doc_id").alias("rep"), F.first("halves").alias("halves"), F.count(F.lit(1)).alias("rows")), "near-reps"
    )

    halves = reps.select("rep", F.posexplode("halves").alias("j", "half"))
    shared = halves.join(halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "half")
    sides = shared.groupBy("rep").agg(
        F.sum("n").alias("weight"),
        F.collect_list(F.when(F.col("j") < side, F.col("half"))).alias("one"),
        F.collect_list(F.when(F.col("j") >= side, F.col("half"))).alias("two"),
    )  # at most 2 * side entries each
    sides = written(sides.filter("size(one) > 0 AND size(two) > 0"), "near-sides")
    keys = sides.select("rep", "weight", F.explode("one").alias("h1"), "two").select("rep", "weight", "h1", F.explode("two").alias("h2"))
    keys = keys.select("rep", "weight", F.xxhash64("h1", "h2").alias("key"))
    # The hub shares the most half keys: of copies with edits it is the one nearest to all others.
    buckets = keys.groupBy("key").agg(F.max(F.struct("weight", "rep"))["rep"].alias("hub"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    members = keys.select("rep", "key").join(buckets.filter("lo != hi").select("key", "hub"), "key")
    members = written(members.select("rep", "key", "hub"), "near-members")

    found = members.select("rep").distinct()
    sets = written(_sets(docs.join(found, F.col("doc_id") == F.col("rep"), "left_semi").select("doc_id", "text"), words), "near-sets")
    if sets.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        sets = sets.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sh")))).alias("sh"))
    stars = members.filter("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = written(_confirmed(stars, sets, percent), "near-links")
    joined = components(links)

    label = F.coalesce("component", "rep")
    placed = members.select("rep", "key").join(joined, F.col("rep") == F.col("id"), "left").select("rep", "key", label.alias("component"))
    placed = written(placed, "near-placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi")
    contested = placed.join(mixed, "key", "left_semi").select("rep", "component").distinct()
    contested = written(contested.join(sets, F.col("rep") == F.col("doc_id")).select("doc_id", "component", "sh"), "near-contested")
    more = _confirmed(_cross_pairs(contested, percent), sets, percent)
    lifted = joined.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)
    final = components(lifted)

    named = F.struct(F.col("n_shingles").alias("n"), F.col("set_key").alias("s"))
    rep_of = reps.join(final, F.col("rep") == F.col("id"), "left").select(named.alias("key"), F.coalesce("component", "rep").alias("component_id"), "rows")
    own = F.struct(F.lit(-1).cast("long").alias("n"), F.array(F.monotonically_increasing_id()).alias("s"))  # no set's key
    key = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), named)
    out = looked_up(features.select("doc_id", "n_shingles", "set_key"), rep_of, key, "rows", ["component_id"], own)
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON r.id = l.a WHERE r.c < l.b),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT s.doc_id, len(s.sh) AS n_shingles, m.c AS component_id, m.c = s.doc_id AS kept FROM s JOIN m ON m.id = s.doc_id
"""
