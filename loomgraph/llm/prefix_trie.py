"""Operator 11: the prefix trie of conversations, from sorted sequences and range minima of their common prefixes.

A turn is a digest, a conversation the row of its turns' digests, so bytewise order puts all members of a prefix side
by side. Conversations are sorted once over the cluster and cut into blocks. In a block, lcp[i] counts the turns that row i
shares with row i-1, and a sparse table answers the least lcp of any stretch: each prefix that is new in a row finds where
its members begin and end by two binary searches, independent of all others. Whatever a node needs (members, children,
leaves, saved tokens) is a difference of prefix sums over that interval. Nodes that reach a block's edge leave their
parts under the digest of their prefix, and the parts are added up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import crc32_sql, looked_up, table, written
from loomgraph.llm.ranks import numbered, ranked

#: Rows of a block; bytes of a turn's digest.
BLOCK, KEY = 512, 16
_NONE = hashlib.sha256(b"").hexdigest()


def shared_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from the first of its hundred."""
    return F.crc32(conv.cast("string")) % 6


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, key, size): a turn's digest over role and text, and its code points; rows without conv_id are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY))
    return conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("key"), F.length(text).alias("size"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, keys, sizes): every conversation with its first turns from the first conversation of its hundred.

    keys holds the turns' digests one after another. Turns go by number, null first; equal numbers by digest.
    """
    turns = written(turn_rows(conversations).withColumn("_seq", F.monotonically_increasing_id()), "trie-turns")
    rows, groups = ranked(turns, "conv_id", [F.col("turn").asc_nulls_first(), "key", "_seq"], "trie-ranked")
    rows = written(rows.select("conv_id", "rank", "key", "size"), "trie-places")
    convs = groups.select("conv_id", F.col("size").alias("turns"), (F.col("conv_id") - F.col("conv_id") % 100).alias("_base"), shared_turns(F.col("conv_id")).alias("_head"))
    convs = written(convs, "trie-conversations")
    # Only the first turns of a base are dealt, to at most a hundred conversations each.
    bases = rows.filter("rank < 5 AND conv_id % 100 = 0").select(F.col("conv_id").alias("_base"), "rank", "key", "size")
    taken = bases.join(convs, "_base").filter("rank < _head").select("conv_id", F.col("rank").alias("at"), "key", "size")
    have = convs.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("_base"), F.col("turns").alias("_have"))
    heads = convs.join(have, "_base", "left").select(F.col("conv_id").alias("key"), "turns", "_head", F.least("_head", F.coalesce("_have", F.lit(0))).alias("_given"))
    spread = -F.monotonically_increasing_id() + F.lit(-(1 << 62))
    own = looked_up(rows.withColumnRenamed("key", "digest"), heads, F.col("conv_id"), "turns", ["_head", "_given"], spread)
    own = own.filter("rank >= _head").select("conv_id", (F.col("rank") - F.col("_head") + F.col("_given")).alias("at"), F.col("digest").alias("key"), "size")
    gathered = taken.unionByName(own).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "key", "size"))).alias("t"))
    keys = F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["key"])), ""))
    full = gathered.select(F.col("conv_id").alias("_conv"), keys.alias("keys"), F.col("t")["size"].alias("sizes"))
    return convs.join(full, F.col("conv_id") == F.col("_conv"), "left").select(
        "conv_id", F.coalesce("keys", F.lit(b"")).alias("keys"), F.coalesce("sizes", F.array().cast("array<int>")).alias("sizes")
    )


def _common(a: bytes, b: bytes) -> int:
    """Turns that two sequences share from the first on."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // KEY
    apart = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(apart.argmax()) // KEY


class LeastOf:
    """A sparse table of values: the least of any stretch, and how far a stretch goes on that has no value below a bound."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << len(self.levels) - 1 <= len(values):
            half, last = 1 << len(self.levels) - 1, self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The least of values[left..right], both inclusive."""
        out = np.empty(len(left), self.levels[0].dtype)
        level = np.floor(np.log2(right - left + 1)).astype(int)
        for k, values in enumerate(self.levels):
            here = level == k
            out[here] = np.minimum(values[left[here]], values[right[here] - (1 << k) + 1])
        return out

    def right(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The largest r so that all of values[start+1..r] are at least bound."""
        at, n = start.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            fits = at + (1 << k) < n
            held = self.levels[k][np.where(fits, at + 1, 0)] >= bound
            at = np.where(fits & held, at + (1 << k), at)
        return at

    def left(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The smallest l so that all of values[l+1..start] are at least bound."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            fits = at - (1 << k) >= 0
            held = self.levels[k][np.where(fits, at - (1 << k) + 1, 0)] >= bound
            at = np.where(fits & held, at - (1 << k), at)
        return at


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_PART = f"{_NODE}, node binary, parent binary, before long, ends string"
_TYPES = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string()]


def _nodes(block: pa.Table, block_rows: int) -> pa.Table:
    """The nodes and parts of nodes of one block; its first and last row may be the neighbours' rows."""
    rows = block.sort_by("row")
    number, home = rows.column("row").to_numpy(), rows.column("block")[0].as_py()
    inside = np.flatnonzero(number // block_rows == home)
    first, last = inside[0], inside[-1]
    all_keys = rows.column("keys").to_pylist()
    has_left, has_right = first > 0, last < len(all_keys) - 1
    keys = all_keys[first : last + 1]
    n = len(keys)
    convs = rows.column("conv_id").to_numpy()[first : last + 1]
    lists = rows.column("sizes").combine_chunks()
    lists = (lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists).slice(first, n)
    sizes = lists.flatten().to_numpy().astype(np.int64)
    length = np.array([len(k) // KEY for k in keys], np.int64)
    # lcp[n] is that of the next block's first row; a row without a neighbour shares nothing, not even the root.
    lcp = np.full(n + 1, -1, np.int64)
    for i in range(1, n):
        lcp[i] = _common(keys[i - 1], keys[i])
    if has_left:
        lcp[0] = _common(all_keys[first - 1], keys[0])
    if has_right:
        lcp[n] = _common(keys[-1], all_keys[last + 1])
    # Code points of a row's first d turns: upto[offset[i] + d].
    offset = np.concatenate([[0], np.cumsum(length + 1)])
    upto = np.zeros(offset[-1], np.int64)
    running = np.concatenate([[0], np.cumsum(sizes)])
    begins = np.concatenate([[0], np.cumsum(length)])
    index = np.arange(offset[-1]) - np.repeat(offset[:-1], length + 1)
    upto = running[np.repeat(begins[:-1], length + 1) + index] - np.repeat(running[begins[:-1]], length + 1)
    shared = upto[offset[:-1] + np.maximum(lcp[:n], 0)]
    ahead = lambda v: np.concatenate([[0], np.cumsum(v)])
    sum_shared, sum_leaf = ahead(shared), ahead((lcp[1:] < length).astype(np.int64))
    # Candidates: per row the prefixes that it is the first to have; in the first row all its prefixes.
    least = np.maximum(lcp[:n] + 1, 0)
    least[0] = 0
    many = length - least + 1
    row = np.repeat(np.arange(n), many)
    depth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + least[row]
    goes_on = depth <= lcp[0]
    goes_on &= row == 0  # begun in an earlier block
    table_ = LeastOf(lcp[:n])
    end = table_.right(row, depth)
    open_ = (end == n - 1) & (lcp[n] >= depth)  # has members in the next block
    edge = goes_on | open_
    lowest, size = LeastOf(convs), end - row + 1
    conv = lowest.least(row, end)
    # Children: rows of the interval that are longer and share exactly depth turns with the row before, or begin the node.
    order = np.lexsort((np.arange(n), lcp[:n]))
    ranks = lcp[order] * (n + 1) + order  # rows by (lcp, place): counted between two bounds by binary search
    longer = ahead((length > lcp[:n])[order].astype(np.int64))
    count = longer[np.searchsorted(ranks, depth * (n + 1) + end, "right")] - longer[np.searchsorted(ranks, depth * (n + 1) + row, "right")]
    child_first = length[row] > depth
    child_first &= ~(goes_on & (lcp[0] > depth))  # the first row's child was begun before, too
    children = count + child_first
    leaves = sum_leaf[end + 1] - sum_leaf[row]
    before = np.where(depth > 0, upto[offset[row] + np.maximum(depth - 1, 0)], 0)
    joined = sum_shared[end + 1] - sum_shared[np.where(goes_on, row, row + 1)]
    # The parent's members, on both sides.
    up = np.maximum(depth - 1, 0)
    from_, to = table_.left(row, up), table_.right(row, up)
    parent = lowest.least(from_, to)
    parent_edge = ((from_ == 0) & (lcp[0] >= up)) | ((to == n - 1) & (lcp[n] >= up))
    # Ends: members of just this many turns come first, in order of their ids.
    same = LeastOf(np.where((lcp[:n] == length) & (np.concatenate([[-1], length[:-1]]) == length), 1, 0))
    ending = length[row] == depth
    stop = np.where(ending, same.right(row, np.ones(len(row), np.int64)), row - 1)
    names = [str(c) for c in convs.tolist()]
    spelled = [",".join(names[a : b + 1]) if e else None for a, b, e in zip(row.tolist(), stop.tolist(), ending.tolist())]
    digests, node, above = [], [], []
    marks = lambda i, d: hashlib.sha256(keys[i][: KEY * d]).digest() if d else b"root"
    for i, d, at_edge, up_edge, text in zip(row.tolist(), depth.tolist(), edge.tolist(), parent_edge.tolist(), spelled):
        digests.append(None if at_edge else hashlib.sha256(text.encode()).hexdigest() if text else _NONE)
        node.append(marks(i, d) if at_edge else None)
        above.append(marks(i, d - 1) if d and up_edge else None)
    root = depth == 0
    columns = [
        conv, depth, pa.array(parent, mask=root | parent_edge), size, children, leaves,
        np.where(edge, joined, joined - (size - 1) * before),
        digests, node, above, before, [t if e else None for t, e in zip(spelled, edge.tolist())],
    ]
    return pa.table([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _TYPES)], names=[f.split()[0] for f in _PART.split(", ")])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each node's ids from their pieces in order, one piece at a time."""
    now, state = None, None
    out = lambda: pa.RecordBatch.from_pydict({"_node": [now], "_ends": [state.hexdigest()]})
    for batch in batches:
        for node, piece in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            if node != now:
                if state is not None:
                    yield out()
                now, state = node, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
    if state is not None:
        yield out()


def prefix_trie(sequences: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """The nodes of the trie of sequences (conv_id unique, keys, sizes), as told for op11_prefix_trie.

    keys are digests of 16 bytes one after another, sizes the code points of the turns. Turns are equal if 128 bits of SHA-256 are.
    Equal sequences are members of the same nodes. Without sequences there is no root.
    """
    rows = written(numbered(written(sequences, "trie-sequences"), ["keys", "conv_id"], "trie-sorted"), "trie-numbered")
    block = F.floor(F.col("row") / block_rows)
    shown = ["row", "conv_id", "keys", "sizes"]
    own = rows.select(block.alias("block"), *shown)
    earlier = rows.filter(F.col("row") % block_rows == block_rows - 1).select((block + 1).alias("block"), *shown)
    later = rows.filter((F.col("row") % block_rows == 0) & (F.col("row") > 0)).select((block - 1).alias("block"), *shown)
    # A neighbour's row alone makes no block.
    blocks = own.unionAll(later).unionAll(earlier.join(own.filter(F.col("row") % block_rows == 0).select("block"), "block", "left_semi"))
    parts = written(blocks.groupBy("block").applyInArrow(lambda t: _nodes(t, block_rows), _PART), "trie-parts")
    names = [f.split()[0] for f in _NODE.split(", ")]
    # Nodes over several blocks: sums of their parts.
    edge = parts.filter("node IS NOT NULL")
    total = lambda c: F.sum(c).alias(c)
    summed = edge.groupBy("node", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent"), total("n_convs"), total("n_children"), total("n_leaves"), total("saved_tokens"), F.max("before").alias("before"))
    pieces = edge.filter("ends IS NOT NULL").select("node", F.split_part("ends", F.lit(","), F.lit(1)).cast("long").alias("_from"), "ends")
    hashed = pieces.repartition("node").sortWithinPartitions("node", "_from").select("node", "ends").mapInArrow(_hashed, "_node binary, _ends string")
    summed = summed.join(hashed, F.col("node") == F.col("_node"), "left").withColumn("ends_sha256", F.coalesce("_ends", F.lit(_NONE)))
    summed = summed.withColumn("saved_tokens", F.col("saved_tokens") - (F.col("n_convs") - 1) * F.col("before")).drop("_node", "_ends")
    summed = written(summed, "trie-edges")
    # Children of such nodes learn their parent's least member; a parent of many is looked up by broadcast.
    asking = parts.filter("node IS NULL").unionByName(summed, allowMissingColumns=True).filter("parent IS NOT NULL").drop("parent_conv_id")
    known = summed.select(F.col("node").alias("key"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    found = looked_up(asking, known, F.col("parent"), "n_children", ["parent_conv_id"], F.concat(F.lit(b"-"), F.col("conv_id").cast("string").cast("binary")))
    rest = parts.filter("node IS NULL AND parent IS NULL").unionByName(summed.filter("parent IS NULL"), allowMissingColumns=True)
    return found.select(*names).unionByName(rest.select(*names))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations, root included.

    Null roles and texts are empty ones; turns without a number come first, turns of one number in order of their digests, repeated
    rows are turns of their own; rows without conv_id are left out; an empty table has no node; other columns are ignored.
    """
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))


ORACLE = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS r, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS turns, conv_id - conv_id % 100 AS base, {crc32_sql('CAST(conv_id AS VARCHAR)')} % 6 AS head FROM t GROUP BY conv_id),
s AS (SELECT c.conv_id, least(c.head, coalesce(b.turns, 0)) AS given, c.head, c.base FROM c LEFT JOIN c b ON b.conv_id = c.base),
u AS (SELECT s.conv_id, t.r AS pos, t.role, t.text FROM s JOIN t ON t.conv_id = s.base AND t.r < s.given
  UNION ALL SELECT s.conv_id, t.r - s.head + s.given, t.role, t.text FROM s JOIN t ON t.conv_id = s.conv_id AND t.r >= s.head),
k AS (SELECT *, sha256(strlen(role) || ':' || role || text) AS key FROM u),
x AS (SELECT conv_id, pos + 1 AS depth, length(text) AS size, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM k
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
m AS (SELECT conv_id, max(depth) AS last FROM x GROUP BY conv_id),
n AS (SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
  coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = last), '') AS ends FROM x JOIN m USING (conv_id) GROUP BY path),
p AS (SELECT *, CASE WHEN depth > 0 THEN left(path, 64 * (depth - 1)) END AS above FROM n),
h AS (SELECT above, count(*) AS children FROM p WHERE above IS NOT NULL GROUP BY above),
q AS (SELECT p.*, coalesce(h.children, 0) AS n_children FROM p LEFT JOIN h ON h.above = p.path),
up AS (SELECT unnest(range(depth + 1)) AS d, path, size, n_convs, n_children FROM q),
w AS (SELECT left(path, 64 * d) AS path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens FROM up GROUP BY 1)
SELECT q.conv_id, CAST(q.depth AS BIGINT) AS depth, a.conv_id AS parent_conv_id, q.n_convs, q.n_children, w.n_leaves, w.saved_tokens, sha256(q.ends) AS ends_sha256
FROM q JOIN w ON w.path = q.path LEFT JOIN q a ON a.path = q.above
"""
