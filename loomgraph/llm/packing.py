"""Operator 6: packing token sequences by cutting-stock column generation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from loomgraph.llm.bpe import public_path, tokenizer
from loomgraph.llm.common import small_batches, table, written

CAPACITY = 4096
#: Width in tokens of a length class: 128 classes, so histogram, patterns and linear program are bounded.
CLASS_WIDTH = 32
#: Every so many rows of a task one document joins the filler stream, which may be cut anywhere.
FILLER_EVERY = 16
END_ID = 2
_FULL, _FILLER = 0, -1
_ROWS = 128

PIECES = T.StructType(
    [
        T.StructField("task", T.IntegerType()),
        T.StructField("row", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("cls", T.IntegerType()),
        T.StructField("nth", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Knapsack by dynamic programming: the pattern of classes with the largest total value."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = np.flatnonzero(sizes <= room)
        best[room] = best[room - 1]
        if len(fits):
            gains = values[fits] + best[room - sizes[fits]]
            k = int(np.argmax(gains))
            if gains[k] > best[room] + 1e-12:
                best[room], took[room] = gains[k], fits[k]
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            pattern[took[room]] += 1
            room -= int(sizes[took[room]])
    return float(best[capacity]), pattern


def cutting_stock(counts: dict[int, int], capacity: int, rounds: int = 4000) -> list[tuple[dict[int, int], int]]:
    """Patterns ({class: pieces}, copies) whose rounded copies hold all counted pieces.

    Revised simplex over patterns: one class per pattern at first, then columns priced by
    best_pattern until none improves (or rounds end; every basis is feasible). Copies are
    rounded down; what is left, at most one copy of each pattern, goes first-fit decreasing.
    """
    sizes = np.array(sorted(k for k, n in counts.items() if n > 0), dtype=np.int64)
    if not len(sizes):
        return []
    demand = np.array([counts[int(s)] for s in sizes], dtype=float)
    basis = np.diag((capacity // sizes).astype(float))
    x = demand / np.diag(basis)
    for _ in range(rounds):
        values = np.linalg.solve(basis.T, np.ones(len(sizes)))
        worth, column = best_pattern(values, sizes, capacity)
        if worth <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        leaves = int(np.argmin(ratio))
        entering = ratio[leaves]
        x = np.maximum(x - entering * step, 0)
        x[leaves], basis[:, leaves] = entering, column
    copies = np.floor(x + 1e-9).astype(np.int64)
    made = [({int(s): int(a) for s, a in zip(sizes, basis[:, j]) if a}, int(n)) for j, n in enumerate(copies) if n]
    left = {int(s): max(0, counts[int(s)] - sum(p.get(int(s), 0) * n for p, n in made)) for s in sizes}
    bins: list[tuple[dict[int, int], int]] = []
    for s in sorted(left, reverse=True):
        for _ in range(left[s]):
            at = next((i for i, (_, room) in enumerate(bins) if room >= s), None)
            if at is None:
                bins.append(({}, capacity))
                at = len(bins) - 1
            pattern, room = bins[at]
            pattern[s] = pattern.get(s, 0) + 1
            bins[at] = (pattern, room - s)
    return made + [(p, 1) for p, _ in bins]


def _cut(docs: DataFrame, text_col: str, path: str, capacity: int, width: int, filler_every: int, end_id: int) -> DataFrame:
    """Encode each document and cut it into full sequences and a rest, or leave it whole as filler."""
    end = end_id.to_bytes(4, "little")
    id_field = docs.schema["doc_id"]
    schema = T.StructType([id_field, *PIECES.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task, row, seen = tokenizer(path), TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part, of, out = batch.slice(lo, _ROWS), [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = bpe.encode(text or "") + end
                    n = len(ids) // 4
                    cuts = [0, n] if row % filler_every == 0 else [*range(0, n, capacity), n]
                    for a, b in zip(cuts, cuts[1:]):
                        if len(cuts) == 2 and row % filler_every == 0:
                            cls, amount = _FILLER, n
                        else:
                            cls, amount = (_FULL if b - a == capacity else -(-(b - a) // width)), 1
                        nth = seen.get(cls, 0)
                        seen[cls] = nth + amount
                        of.append(i)
                        out.append((task, task << 36 | row, a, b - a, n, cls, nth, ids[4 * a : 4 * b]))
                    row += 1
                columns = [pa.array(c, f) for c, f in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.large_binary()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(of)), *columns], schema.names)

    return small_batches(docs).select("doc_id", F.col(text_col).alias("text")).mapInArrow(run, schema)


def _places(pieces: DataFrame, patterns: list[tuple[dict[int, int], int]], width: int) -> DataFrame:
    """sequence_id and slot of ranked pieces: each class's ranks run through the patterns in turn."""
    ranges: dict[int, list[tuple[int, int, int]]] = {}
    first, seq = {}, 0
    for pattern, copies in patterns:
        for cls, each in pattern.items():
            lo = first.get(cls, 0)
            ranges.setdefault(cls, []).append((lo, seq, each))
            first[cls] = lo + each * copies
        seq += copies
    tables = {c: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for c, r in ranges.items()}
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("slot", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cls", "rank"))
            seq, slot = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for c in np.unique(cls):
                lo, base, each = tables[int(c)]
                at = np.flatnonzero(cls == c)
                k = np.searchsorted(lo, rank[at], side="right") - 1
                seq[at] = base[k] + (rank[at] - lo[k]) // each[k]
                slot[at] = (rank[at] - lo[k]) % each[k] - int(c) * 8192  # large classes first
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq), pa.array(slot)], schema.names)

    return small_batches(pieces).mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
    width: int = CLASS_WIDTH,
    filler_every: int = FILLER_EVERY,
    end_id: int = END_ID,
) -> DataFrame:
    """Pack all documents' tokens, each closed by end_id, into sequences of at most capacity tokens.

    Returns one row per piece: id_col, start, length, doc_tokens, sequence_id, offset and ids
    (little-endian unsigned 32-bit).

    Full stretches of long documents are sequences of their own. The rests are ranked within
    length classes; the bounded histogram of classes goes to the driver, where column
    generation finds patterns, and arithmetic on (class, rank) assigns each rest its sequence.
    Every filler_every-th document is not classed but joins a token stream that is cut to fill
    the room the classes leave, then into whole sequences; so only the last sequence and,
    if the stream is too short, some others have padding. capacity must be a multiple of width.

    Defined cases: null and empty text is the end token alone; documents of any length are cut;
    null or repeated ids and repeated rows are packed row by row; pieces of one length class are ordered by
    where their rows stand, which decides their sequence and nothing else; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    if capacity % width:
        raise ValueError("capacity must be a multiple of width")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cut = written(_cut(source, "text", path or public_path(), capacity, width, filler_every, end_id), "pack-pieces")

    # Rank of each piece in its class: ranks within tasks are known, tasks follow one another.
    before = W.partitionBy("cls").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    amount = F.when(F.col("cls") == _FILLER, F.col("length")).otherwise(1)
    bases = written(
        cut.groupBy("task", "cls").agg(F.sum(amount).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))),
        "pack-bases",
    )
    totals = {r["cls"]: r["n"] for r in bases.groupBy("cls").agg(F.sum("n").alias("n")).collect()}  # a row per class
    full, stream = totals.pop(_FULL, 0), totals.pop(_FILLER, 0)
    patterns = cutting_stock(totals, capacity // width)
    n_patterns = sum(n for _, n in patterns)
    ranked = cut.join(bases.select("task", "cls", "base"), ["task", "cls"]).withColumn("rank", F.col("nth") + F.col("base"))

    rests = _places(ranked.filter(F.col("cls") > 0), patterns, width)
    slim = _places(ranked.filter(F.col("cls") > 0).select("length", "cls", "rank"), patterns, width)
    gaps = slim.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("gap")).filter("gap > 0")
    gaps = written(gaps.repartitionByRange("sequence_id").withColumn("part", F.spark_partition_id()), "pack-gaps")
    parts = gaps.groupBy("part").agg(F.sum("gap").alias("n"))  # a row per partition
    parts = parts.select("part", "n", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    room = gaps.agg(F.sum("gap")).first()[0] or 0
    inside = W.partitionBy("part").orderBy("sequence_id").rowsBetween(W.unboundedPreceding, -1)
    gaps = gaps.join(parts.select("part", "base"), "part").select(
        "sequence_id", "gap", (F.col("base") + F.coalesce(F.sum("gap").over(inside), F.lit(0))).alias("at")
    )

    filler = ranked.filter(F.col("cls") == _FILLER).select("row", "length", F.col("rank").alias("from"))

    def blocks(at: str, n: str):
        return F.explode(F.sequence((F.col(at) / capacity).cast("long"), ((F.col(at) + F.col(n) - 1) / capacity).cast("long")))

    lo, hi = F.greatest("at", "from"), F.least(F.col("at") + F.col("gap"), F.col("from") + F.col("length"))
    fill = (
        gaps.withColumn("block", blocks("at", "gap"))
        .join(filler.filter(F.col("from") < room).withColumn("block", blocks("from", "length")), "block")
        .filter((lo < hi) & ((lo / capacity).cast("long") == F.col("block")))
        .select("row", (lo - F.col("from")).alias("start"), (hi - lo).alias("n"), "sequence_id", lo.alias("slot"))
    )
    rest_at = F.greatest(F.col("from"), F.lit(room)) - room
    rest_end = F.col("from") + F.col("length") - room
    tail_lo, tail_hi = F.greatest(rest_at, F.col("k") * capacity), F.least(rest_end, (F.col("k") + 1) * capacity)
    tail = (
        filler.filter(rest_end > 0)
        .withColumn("k", F.explode(F.sequence((rest_at / capacity).cast("long"), ((rest_end - 1) / capacity).cast("long"))))
        .select(
            "row",
            (tail_lo + room - F.col("from")).alias("start"),
            (tail_hi - tail_lo).alias("n"),
            (F.col("k") + (n_patterns + full)).alias("sequence_id"),
            tail_lo.alias("slot"),
        )
    )
    columns = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "slot", "ids"]
    streamed = (
        fill.unionByName(tail)
        .join(cut.filter(F.col("cls") == _FILLER).select("row", "doc_id", "doc_tokens", F.col("ids").alias("whole")), "row")
        .withColumn("ids", F.substring("whole", (F.col("start") * 4 + 1).cast("int"), (F.col("n") * 4).cast("int")))
        .withColumnRenamed("n", "length")
    )
    earlier = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    shared = rests.select(*columns).unionByName(streamed.select(*columns)).withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
    alone = ranked.filter(F.col("cls") == _FULL).withColumn("sequence_id", F.col("rank") + n_patterns).withColumn("offset", F.lit(0).cast("long"))
    out = [F.col("doc_id").alias(id_col), "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    return shared.select(*out).unionByName(alone.select(*out))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed; the checksum of each piece's ids in place of the ids."""
    placed = pack(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
