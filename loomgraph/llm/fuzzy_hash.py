"""Operator 12: document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last 7 bytes cuts a text into chunks wherever it is -1 modulo the block size, so an
edit changes the chunks around it and no others. A fingerprint holds the signature of the chunks at a block
size and at twice that size; two fingerprints are compared by the edit distance of the signatures that have
a block size in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.llm.common import small_batches, table, written

WINDOW = 7
#: Block sizes are LEAST times a power of two: the smallest by which CHUNKS blocks hold the text. Texts that repeat one passage may be
#: cut far more often; from MANY chunks on the block size is doubled.
LEAST, CHUNKS, MANY = 3, 64, 4096
#: A stretch without a cut is cut after so many block sizes, counted from the last cut.
LONGEST = 4
_BASE64 = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_FACTOR = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_TABLE = np.random.default_rng(12).integers(0, 1 << 63, 256, dtype=np.uint64)  # a value per byte


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out[:n]


def _rolling(data: np.ndarray) -> np.ndarray:
    """For each byte the rolling hash of the last WINDOW bytes: their sum, their weighted sum and a shifted exclusive or, added up."""
    n = len(data)
    wide = np.concatenate([np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32)])
    total, mixed = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for back in range(WINDOW):
        byte = wide[WINDOW - 1 - back : WINDOW - 1 - back + n]
        total += byte * np.uint32(1 + WINDOW - back)
        mixed ^= byte << np.uint32(5 * back)
    return total + mixed


def _signature(sums: np.ndarray, back: np.ndarray, ends: np.ndarray) -> bytes:
    """Two base-64 letters for each chunk that ends before one of ends; sums are prefix sums of the weighted bytes."""
    starts = np.concatenate([[0], ends[:-1]])
    own = (sums[ends] - sums[starts]) * back[starts]
    own ^= own >> np.uint64(29)
    own *= np.uint64(0xBF58476D1CE4E5B9)
    own >>= np.uint64(52)
    return _BASE64[np.stack([own >> np.uint64(6), own & np.uint64(63)], 1).astype(np.int64)].tobytes()


def _ends(cuts: np.ndarray, longest: int) -> np.ndarray:
    """cuts, with one more after every longest bytes of a stretch that has none."""
    starts = np.concatenate([[0], cuts[:-1]])
    more = (cuts - starts - 1) // longest
    if not more.any():
        return cuts
    inner = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
    return np.sort(np.concatenate([cuts, np.repeat(starts, more) + (inner + 1) * longest]))


def fingerprint(text: str) -> str:
    """block size:signature:signature at twice the size, over the text's UTF-8 bytes; 3:: for the empty text.

    The whole text counts, whatever its length; the number of chunks is not capped.
    """
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    if not n:
        return f"{LEAST}::"
    cut = _rolling(data).astype(np.int64) + 1
    at = np.flatnonzero(cut % LEAST == 0)
    at = at[at < n - 1]
    steps = cut[at] // LEAST
    power = np.minimum(np.log2(steps & -steps).astype(np.int64), 40) if len(at) else at
    beyond = np.cumsum(np.bincount(power, minlength=42)[::-1])[::-1]  # cuts at LEAST * 2**k or above
    k = max(0, (-(-n // (LEAST * CHUNKS)) - 1).bit_length())
    k += int(np.argmax(beyond[k:] < MANY))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers(_FACTOR, n), out=sums[1:])
    back = _powers(_INVERSE, n)
    parts = [_signature(sums, back, _ends(np.append(at[power >= level] + 1, n), LONGEST * LEAST << level)) for level in (k, k + 1)]
    return f"{LEAST << k}:{parts[0].decode()}:{parts[1].decode()}"


def _common(a: list, b: list) -> int:
    """Length of the longest common subsequence, a machine-independent bit-parallel scan."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & at.get(x, 0)
        if hit:
            row = (row + hit) | (row - hit)
    return len(a) - (row & full).bit_count()


def _alike(a: str, b: str) -> float:
    """1 less the edit distance (chunks put in and taken out) over the chunks of both."""
    if a == b:
        return 1.0
    one, two = [a[i : i + 2] for i in range(0, len(a), 2)], [b[i : i + 2] for i in range(0, len(b), 2)]
    distance = len(one) + len(two) - 2 * _common(one, two)
    return 1.0 - distance / (len(one) + len(two))


def likeness(left: str, right: str) -> float:
    """0 to 1; 1 for equal fingerprints, 0 where block sizes are more than a factor of two apart or no chunk is shared."""
    if left == right:
        return 1.0
    (size, *a), (other, *b) = left.split(":"), right.split(":")
    size, other = int(size), int(other)
    if size == other:
        return max(_alike(a[0], b[0]), _alike(a[1], b[1]) if a[1] and b[1] and min(len(a[1]), len(b[1])) >= 16 else 0.0)
    if size == 2 * other:
        return _alike(a[0], b[1])
    if other == 2 * size:
        return _alike(a[1], b[0])
    return 0.0


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SCHEMA = f"kind string, _part long, {_ROW}, text string"
_NAMES = [f.split()[0] for f in _SCHEMA.split(", ")]


def _compared(doc, text: str, print_: str, following: str, next_print: str) -> tuple:
    n = len(text)
    edited = text[: n - n // 3] + following[: n // 3]
    mine = fingerprint(edited) if edited != text else print_
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc, n, digest, print_, mine, likeness(print_, mine), likeness(print_, next_print)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
    columns = zip(*rows) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], _NAMES)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one part in order: each with its follower; the first and the last also go out with their texts, for the seams."""
    held, part = None, None
    for batch in batches:
        rows = []
        for doc, text, part in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("_part").to_pylist()):
            mark = fingerprint(text)
            if held is None:
                rows.append(("first", part, doc, None, None, mark, None, None, None, text))
            else:
                rows.append(("row", part, *_compared(*held, text, mark), None))
            held = doc, text, mark
        if rows:
            yield _batch(rows)
    if held is not None:
        yield _batch([("last", part, held[0], None, None, held[2], None, None, None, held[1])])


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [("row", None, *_compared(r["doc_id"], r["text"], r["fingerprint"], r["next_text"], r["next_print"]), None) for r in batch.to_pylist()]
        yield _batch(rows)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its fingerprint, that of its text with the last third replaced from the next document, and likenesses.

    The next document is the one with the next smaller id (an integer); after the last comes the first, and a single document is
    its own. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts are shuffled once, by ranges of the id, and neighbours meet as they stream by; two texts per part are
    paired afterwards. Null text is the empty text; null ids come after all others; rows that repeat an id follow one another in
    the order of their texts' digests, each a document; an empty table gives an empty result; other columns are ignored. Lone surrogates do not occur in Spark strings.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("_tie"), F.col("_seq")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64("text")).withColumn("_seq", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id().cast("long"))
    done = written(small_batches(dealt.select("doc_id", "text", "_part")).mapInArrow(_neighbours, _SCHEMA), "fingerprints")
    parts = done.filter("kind = 'first'").select("_part")  # one row a part
    around = W.orderBy("_part")
    follows = parts.select("_part", F.coalesce(F.lead("_part").over(around), F.min("_part").over(W.partitionBy())).alias("_next"))
    first = done.filter("kind = 'first'").select(F.col("_part").alias("_next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    last = done.filter("kind = 'last'").select("_part", "doc_id", "text", "fingerprint")
    seams = last.join(follows, "_part").join(first, "_next").select("doc_id", "text", "fingerprint", "next_text", "next_print").mapInArrow(_seams, _SCHEMA)
    names = _NAMES[2:-1]
    return done.filter("kind = 'row'").select(*names).unionAll(seams.select(*names))


def op12_fuzzy_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and how like it is to its edited text and to the next document."""
    return fingerprints(table(spark, sf_dir, "documents"))
