"""Operator 10: exact embedding near-duplicates by cover trees within cells of a metric partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import table, written
from loomgraph.llm.components import components
from loomgraph.llm.cover_tree import CoverTree, dual_links, least_reachable

COSINE = 0.98
#: Rows of one tree; larger cells are split into blocks of about this size.
BLOCK = 2048
_ROWS = 1024
#: Pivots of all labels together; only labels larger than a block have any.
PIVOTS = 2048
_CELLS = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("cell", T.IntegerType()),
        T.StructField("home", T.BooleanType()),
        T.StructField("id", T.LongType()),
        T.StructField("w", T.LongType()),
        T.StructField("unit", T.BinaryType()),
    ]
)


def _units(values: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of norm 1."""
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that the norm of tiny or huge components is right
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells(reps: DataFrame, pivots: dict[str, np.ndarray], cosine: float) -> DataFrame:
    """Each vector at home in its nearest pivot's cell, and a guest in every earlier cell where a link may lie.

    A link within reach r can cross the plane midway between the pivots p and q of both homes only if either end lies
    within r of it; for y at home with q that is y.q - y.p <= r |p - q|.
    """
    reach = float(np.sqrt(2 - 2 * cosine))
    shared = reps.sparkSession.sparkContext.broadcast(pivots)  # at most 2 * PIVOTS vectors
    kinds = (pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = {label: np.sqrt(np.maximum(2 - 2 * p @ p.T, 0)) for label, p in shared.value.items()}
        for batch in batches:
            label = batch.column("label").dictionary_encode()
            codes = label.indices.to_numpy()
            for code, name in enumerate(label.dictionary.to_pylist()):
                rows = np.flatnonzero(codes == code)
                for lo in range(0, len(rows), _ROWS):
                    part = batch.take(pa.array(rows[lo : lo + _ROWS]))
                    unit = _units(part.column("embedding"))
                    n = len(unit)
                    if name in between:
                        g = unit @ shared.value[name].T
                        home = g.argmax(axis=1)
                        beyond = g[np.arange(n), home][:, None] - g <= reach * between[name][home] + 1e-9
                        row, cell = np.nonzero(beyond & (np.arange(g.shape[1]) <= home[:, None]))
                    else:
                        row, cell, home = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
                    raw = [u.tobytes() for u in unit]
                    columns = [[name] * len(row), cell, cell == home[row], part.column("id").take(pa.array(row)), part.column("w").take(pa.array(row)), [raw[i] for i in row]]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], _CELLS.names)

    return reps.select("label", "id", "w", "embedding").mapInArrow(run, _CELLS)


def near_embeddings(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    block: int = BLOCK,
    pivots: int = PIVOTS,
) -> DataFrame:
    """Link all vectors of one label with a cosine >= cosine (above 0.5), in double precision.

    Returns one row per input row: id_col, n_links, component_id, kept.

    Identical vectors of a label are one weighted vector. Labels larger than a block are parted
    into cells around sampled pivots; a vector is a guest in every earlier cell where it may have a link,
    so cells are independent and a pair meets once. Large cells are split into blocks, and each pair of home blocks, or of a
    home block and a block of guests, is one dual traversal of two cover trees and a group of its own in the
    shuffle. Rows get their exact number of links and one edge to the least vector reached, never all pairs.

    Defined cases: ids that are not whole numbers are refused; vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    label or id, link with nothing; vectors of different length never link; rows that repeat an
    id are separate vectors; identical vectors link; an empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    if not isinstance(vectors.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} must hold whole numbers, by which components are named")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("l"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = F.col("id").isNotNull() & F.col("l").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda c: c != 0)
    usable = F.coalesce(usable, F.lit(False))
    rows = rows.withColumn("label", F.when(usable, F.concat_ws("/", F.col("l").cast("string"), F.size("embedding").cast("string"))))
    reps = rows.filter("label IS NOT NULL").groupBy("label", "embedding").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"))
    reps = written(reps, "vector-reps")

    large = reps.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    large = large.orderBy(F.desc("n"), "label").limit(pivots).collect()  # at most `pivots` rows
    total = sum(r["n"] for r in large)
    chosen: dict[str, np.ndarray] = {}
    if large:
        # Each label's share of pivots, taken by the hash of the id: a bounded sample.
        share = {r["label"]: min(1.0, max(1, min(r["n"] // block, pivots * r["n"] // total)) / r["n"]) for r in large}
        wanted = F.create_map([F.lit(x) for k, v in share.items() for x in (k, v)])
        luck = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
        found = reps.filter(luck < wanted[F.col("label")]).select("label", "embedding").limit(2 * pivots).toArrow()
        for label in set(found["label"].to_pylist()):
            chosen[label] = _units(found.filter(pc.field("label") == label)["embedding"].combine_chunks())

    cells = written(_cells(reps, chosen, cosine), "vector-cells")
    n_home, n_guest = F.ceil(F.count_if("home") / block).cast("int"), F.ceil(F.count_if(~F.col("home")) / block).cast("int")
    sizes = cells.groupBy("label", "cell").agg(n_home.alias("n_home"), n_guest.alias("n_guest")).filter("n_home > 0")
    placed = cells.join(sizes, ["label", "cell"])
    # Blocks 0 .. n_home - 1 hold rows at home, the following ones guests; guests don't meet each other.
    own = F.when(F.col("home"), F.pmod(F.xxhash64("id"), F.col("n_home"))).otherwise(F.col("n_home") + F.pmod(F.xxhash64("id"), F.col("n_guest"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n_home") + F.when(F.col("home"), F.col("n_guest")).otherwise(0) - 1))
    dealt = placed.withColumn("own", own).withColumn("other", other)
    dealt = dealt.select("label", "cell", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "id", "w", "unit")

    def traverse(group: pa.Table) -> pa.Table:
        block_of, ids, w = group["own"].to_numpy(), group["id"].to_numpy(), group["w"].to_numpy().astype(float)
        x = np.frombuffer(b"".join(group["unit"].to_pylist()), dtype=np.float64).reshape(len(ids), -1)
        first, second = group["a"][0].as_py(), group["b"][0].as_py()
        mine, others = np.flatnonzero(block_of == first), np.flatnonzero(block_of == second)
        tree = CoverTree(x[mine])
        if first == second:
            links, _, groups = dual_links(tree, tree, cosine, w[mine], w[mine])
            names = ids[mine]
        else:
            left, right, groups = dual_links(tree, CoverTree(x[others]), cosine, w[mine], w[others])
            links, names = np.concatenate((left, right)), np.concatenate((ids[mine], ids[others]))
        least = least_reachable(groups, names)
        found = links > 0
        return pa.table({"id": names[found], "n": np.rint(links[found]).astype(np.int64), "least": least[found]})

    pairs = ["label", "cell", "a", "b"]
    found = dealt.repartition(*pairs).groupBy(*pairs).applyInArrow(traverse, "id long, n long, least long")
    # A block that meets itself holds each row's link with itself: that is taken off, the row's copies stay.
    found = written(found, "vector-links")
    counts = found.groupBy("id").agg((F.sum("n") - 1).alias("n_links"))
    joined = components(found.filter("least < id").select(F.col("id").alias("a"), F.col("least").alias("b")))
    classes = (
        reps.select("label", "embedding", F.col("id").alias("rep"))
        .join(counts.withColumnRenamed("id", "rep"), "rep")
        .join(joined.select(F.col("id").alias("rep"), "component"), "rep", "left")
        .select("label", "embedding", "n_links", F.coalesce("component", "rep").alias("component"))
    )
    out = rows.join(classes, ["label", "embedding"], "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings."""
    return near_embeddings(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a),
r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT p.b, r.c FROM r JOIN p ON r.id = p.a WHERE r.c < p.b),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT m.id AS vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, m.c = m.id AS kept
FROM m LEFT JOIN n ON n.a = m.id
"""
