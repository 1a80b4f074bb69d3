"""Many force steps over nodes that stay in place: blocks of space keep their nodes, and a step exchanges border nodes only.

Nodes are dealt once to blocks: grid cells, crowded ones in several parts. Each block keeps, beside its nodes, the edges of its nodes
and the lists of its nodes that other blocks need: those near their cell, and the other ends of their edges. Blocks are buckets of a
table, so a step reads them without a shuffle; only the lists' positions travel. Lists are drawn wider than the reach by a skin on
either side, and hold until a node has moved further than the skin; then all nodes are dealt anew before the next step. While nodes are
so crowded that lists would hold each of them more than MOST_TILES times, a step is a single step in tiles, and dealing is tried again after it.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.operators.layout import AXES, MOST_TILES, Params, _with_crowded, dense_forces, edge_mass, edge_step, push, run_steps
from loomgraph.sources.tables import discarded, scratch_path, settled, shuffles_removed

#: Nodes of a block, about, where they are few, and at most; edges of one node that may meet in its block. Larger blocks send fewer of their nodes to others.
BLOCK, MOST_BLOCK, MOST_EDGES = 2048, 1 << 15, 1 << 17
#: Blocks for each partition of the session, about, before they get larger than BLOCK; own nodes that meet the nodes around them at once, about.
_SPREAD, _MEET = 4, 64
#: Nodes of a task, about.
_TASK_NODES = 1 << 17
_STATE = [*AXES, "vx", "vy", "vz", "m", "x0", "y0", "z0"]
_LISTS = ", ".join(f"{c} array<double>" for c in _STATE)
_ROWS = f"block long, to long, drift double, id array<long>, {_LISTS}"
#: What a block keeps: the blocks that need nodes of it, how many each, and their ids one after another; its nodes' edges.
_FIXED = "block long, needs array<long>, many array<int>, sent array<long>, own array<long>, other array<long>, weight array<double>"


def _buckets(df: DataFrame, name: str, count: int) -> tuple[DataFrame, str]:
    """(df as a table in buckets by block in the shared folder, the table's name); every task writes its own buckets."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(count, "block").option("path", scratch_path(spark, name)).saveAsTable(table)
    return spark.table(table), table


def _dropped(df: DataFrame, name: str) -> None:
    """A table that nothing reads any more, and its files."""
    discarded(df)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


class BlockLayout:
    """A layout under way. nodes: id, x, y, z, vx, vy, vz, mass; edges: source, target, weight; other columns of nodes are joined at the end."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, params: Params, skin: float | None = None, block: int | None = None, side: float | None = None):
        self.params, self.block = params, block
        self.skin = params.reach / 4 if skin is None else skin
        self.around = params.reach + 2 * self.skin
        self.side = side
        self.count = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.edges = edges
        self.dealt = 0  # how often all nodes were dealt
        self.now = self.crowded = None  # the blocks' table, or the nodes while they are too crowded for blocks
        self.moved = False  # whether nodes have left what the lists allow for
        self._deal(nodes.select("id", *AXES, "vx", "vy", "vz", edge_mass(params).alias("m")))

    def _sides(self, n: int, box: list[float], block: int) -> tuple[list[float], list[bool]]:
        """Width of a cell along each axis, and whether there is more than one: axes that are short next to a cell are not cut."""
        if self.side:
            return [max(self.around, self.side)] * 3, [True] * 3
        wide = [max(b, self.around) for b in box]
        room, sides, cut = np.prod(wide) * block / n, [0.0] * 3, [False] * 3
        for left, a in zip((3, 2, 1), sorted(range(3), key=lambda a: wide[a])):
            even = max(room ** (1 / left), self.around)
            count = 1 if wide[a] < 1.5 * even else int(wide[a] / even)
            sides[a], cut[a] = wide[a] / count * (1.0 + 1e-9), count > 1
            room /= sides[a]
        return sides, cut

    def _deal(self, nodes: DataFrame) -> None:
        """Cells hold about a block's nodes if they fill their box evenly, but are no narrower than what a node needs around it."""
        n, *box = nodes.agg(F.count(F.lit(1)), *(f(c) for c in AXES for f in (F.min, F.max))).first()
        low = dict(zip(AXES, box[::2]))
        self.count = max(self.count, n // _TASK_NODES)
        size = self.block or min(max(BLOCK, n // (_SPREAD * self.count)), MOST_BLOCK)
        sides, cut = self._sides(n, [hi - lo for lo, hi in zip(box[::2], box[1::2])], size)
        keys = [f"c{a}" for a in AXES]
        at = {a: F.col(a) - low[a] for a in AXES}
        parts = nodes.select("*", *(F.floor(at[a] / side).alias(f"c{a}") for a, side in zip(AXES, sides)))
        sizes = settled(parts.groupBy(*keys).agg(F.greatest(F.round(F.count(F.lit(1)) / size), F.lit(1.0)).cast("long").alias("n")), "layout-cells")  # cells somewhat fuller than others stay whole
        block = lambda n: F.xxhash64(*keys, n)
        placed = _with_crowded(parts, sizes.filter("n > 1"), keys).fillna(1, ["n"])
        placed = settled(placed.withColumn("block", block(F.pmod(F.xxhash64("id"), F.col("n")))).drop("n"), "layout-placed")
        # Lists for near cells: all parts of the cells whose box is within reach of a node, skins included.
        near, far = placed.select("id", "block", *keys, *AXES), F.lit(0.0)
        for a, side, several in zip(AXES, sides, cut):
            if several:
                near = near.withColumn("_k", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
                gap = F.when(F.col("_k") == 0, 0.0).when(F.col("_k") < 0, at[a] - F.col(f"c{a}") * side).otherwise((F.col(f"c{a}") + 1) * side - at[a])
                near = near.withColumn(f"_g{a}", gap).withColumn(f"c{a}", F.col(f"c{a}") + F.col("_k")).drop("_k")
                far = far + F.col(f"_g{a}") * F.col(f"_g{a}")
                near = near.filter(far <= self.around * self.around)
        near = settled(near.join(sizes, keys).select("id", "block", *keys, "n"), "layout-near")
        self.moved, self.crowded = False, None
        if near.agg(F.sum("n")).first()[0] > MOST_TILES * n:
            self.now, self.crowded = None, placed.select(*nodes.columns)
            discarded(near)
            return
        self.dealt += 1
        spatial = near.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select("id", "block", block(F.col("_p")).alias("to")).filter("block != to")
        # Lists for edges: either end needs the other one.
        home = placed.select("id", "block")
        ends = self.edges.select("source", "target", F.col("weight").cast("double").alias("weight"))
        for end, at_ in (("source", "_s"), ("target", "_t")):
            ends = ends.join(home.select(F.col("id").alias(end), F.col("block").alias(at_)), end)
        both = F.explode(F.array(*(F.struct(F.col(b).alias("block"), F.col(t).alias("to"), F.col(o).alias("own"), F.col(x).alias("other"), "weight") for b, t, o, x in (("_s", "_t", "source", "target"), ("_t", "_s", "target", "source")))))
        needs = ends.select(both.alias("e")).select("e.*").unionAll(spatial.select("block", "to", "id", F.lit(None).cast("long"), F.lit(None).cast("double")))
        self.fixed, _ = _buckets(needs.repartition(self.count, "block").groupBy("block").applyInArrow(_kept, _FIXED), "layout_fixed", self.count)
        rows = placed.select("block", "id", *AXES, "vx", "vy", "vz", "m").repartition(self.count, "block")
        start = rows.groupBy("block").cogroup(self.fixed.groupBy("block")).applyInArrow(_first, _ROWS)
        self.now, self.name = _buckets(start, "layout_state", self.count)
        for used in (sizes, placed, near):
            discarded(used)

    def advance(self, steps: int) -> "BlockLayout":
        """steps more steps; each writes the blocks' state and the lists' positions, of which the latter are the next step's shuffle."""
        params = self.params
        for _ in range(steps):
            if self.moved:
                before = self.crowded
                self._deal(self._rows())
                discarded(before)
            if self.crowded is not None:
                before, self.moved = self.crowded, True
                self.crowded = settled(edge_step(before, self.edges, params, m=F.col("m")), "layout-crowded")
                discarded(before)
                continue
            state = self.now.filter("to IS NULL").drop("to", "drift").join(self.fixed, "block", "left")
            lists = self.now.filter("to IS NOT NULL").select(F.col("to").alias("block"), *(F.col(c).alias(c) for c in ("id", *AXES, "m")))
            made = state.groupBy("block").cogroup(lists.groupBy("block")).applyInArrow(lambda own, other: _step(own, other, params), _ROWS)
            seen = Observation()
            before, old = self.now, self.name
            self.now, self.name = _buckets(made.observe(seen, F.max("drift").alias("drift")), "layout_state", self.count)
            _dropped(before, old)
            self.moved = (seen.get["drift"] or 0.0) > self.skin
        return self

    def _rows(self) -> DataFrame:
        if self.crowded is not None:
            return self.crowded
        return self.now.filter("to IS NULL").select(F.explode(F.arrays_zip("id", *AXES, "vx", "vy", "vz", "m")).alias("n")).select("n.*")

    def nodes(self, before: DataFrame) -> DataFrame:
        """before with the positions and velocities of now."""
        motion = [*AXES, "vx", "vy", "vz"]
        now = self._rows().select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in motion))
        return before.join(now, F.col("id") == F.col("_id")).select(*(F.col(f"_{c}").alias(c) if c in motion else F.col(c) for c in before.columns))


_TYPES = pa.schema([("block", pa.int64()), ("to", pa.int64()), ("drift", pa.float64()), ("id", pa.list_(pa.int64())), *((c, pa.list_(pa.float64())) for c in _STATE)])


def _values(rows: pa.Table, name: str) -> np.ndarray:
    """The lists of all rows one after another."""
    return np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in rows[name].chunks] or [np.zeros(0)])


def _columns(rows: pa.Table) -> dict[str, np.ndarray]:
    return {c: _values(rows, c) for c in rows.column_names if c in {"id", *_STATE}}


def _kept(rows: pa.Table) -> pa.Table:
    """One row of what a block keeps, of rows (block, to, own, other, weight): own is needed in block to, and has an edge if there is another."""
    block, to, own = (rows[c].to_numpy() for c in ("block", "to", "own"))
    away = to != block
    to, sent = to[away], own[away]
    order = np.lexsort((sent, to))
    to, sent = to[order], sent[order]
    first = np.r_[True, (to[1:] != to[:-1]) | (sent[1:] != sent[:-1])][: len(to)]
    to, sent = to[first], sent[first]
    needs, many = np.unique(to, return_counts=True)
    edges = rows.filter(rows["other"].is_valid())
    values = [needs, many.astype(np.int32), sent, *(edges[c].to_numpy() for c in ("own", "other", "weight"))]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in values]
    return pa.Table.from_arrays([pa.array(block[:1]), *lists], names=["block", "needs", "many", "sent", "own", "other", "weight"])


def _written(block: int, own: dict[str, np.ndarray], fixed: pa.Table, drift: float) -> pa.Table:
    """The block's row and one row per list. Nodes are in the order of their ids."""
    needs, many, sent = (_values(fixed, c) for c in ("needs", "many", "sent"))
    rows, n = 1 + len(needs), len(own["id"])
    chosen = np.searchsorted(own["id"], sent).astype(np.int64)
    ends = np.concatenate([[0, n], n + np.cumsum(many)]).astype(np.int32)
    alone = np.concatenate([[0], np.full(rows, n)]).astype(np.int32)
    heads = [pa.array(np.full(rows, block)), pa.array(np.r_[0, needs].astype(np.int64), mask=np.arange(rows) == 0), pa.array(np.r_[drift, np.zeros(rows - 1)])]
    lists = []
    for c in ("id", *_STATE):
        listed = c in {"id", *AXES, "m"}
        lists.append(pa.ListArray.from_arrays(pa.array(ends if listed else alone), pa.array(np.concatenate([own[c], own[c][chosen]]) if listed else own[c])))
    return pa.Table.from_arrays([*heads, *lists], names=["block", "to", "drift", "id", *_STATE])


def _first(rows: pa.Table, fixed: pa.Table) -> pa.Table:
    if not rows.num_rows:
        raise ValueError("lists of a block that does not exist")
    order = np.argsort(rows["id"].to_numpy())
    own = {c: rows[c if c[-1] != "0" else c[0]].to_numpy()[order] for c in ("id", *_STATE)}
    return _written(rows["block"][0].as_py(), own, fixed, 0.0)


def _repelled(own: dict[str, np.ndarray], near: dict[str, np.ndarray], params: Params) -> np.ndarray:
    """Force on each own node from all near ones within reach: those of a cube of small cells meet all nodes of its cells and of those around it at once."""
    mine = np.stack([np.floor(own[a] / params.reach) for a in AXES], 1).astype(np.int64)
    cells = np.stack([np.floor(near[a] / params.reach) for a in AXES], 1).astype(np.int64)
    cube = int(np.clip(round((_MEET * len(np.unique(mine, axis=0)) / len(mine)) ** (1 / 3)), 1, 8))
    low = cells.min(axis=0) - cube
    width = cells.max(axis=0) - low + cube + 1
    number = lambda c: ((c[:, 0] - low[0]) * width[1] + c[:, 1] - low[1]) * width[2] + c[:, 2] - low[2]
    keys = number(cells)
    order = np.lexsort((near["id"], keys))
    keys, around = keys[order], np.stack([near[c][order] for c in (*AXES, "m")])
    mine = (mine - low) // cube * cube + low  # the first cell of each node's cube
    sorted_by_cube = np.argsort(number(mine), kind="stable")
    mine, nodes = mine[sorted_by_cube], np.stack([own[c] for c in (*AXES, "m")])[:, sorted_by_cube]
    first = np.flatnonzero(np.r_[True, np.any(mine[1:] != mine[:-1], axis=1)])
    rows = [mine[first] + np.array([dx, dy, 0]) for dx in range(-1, cube + 1) for dy in range(-1, cube + 1)]
    begin = np.stack([np.searchsorted(keys, number(r + np.array([0, 0, -1])), "left") for r in rows], 1).tolist()
    end = np.stack([np.searchsorted(keys, number(r + np.array([0, 0, cube])), "right") for r in rows], 1).tolist()
    force, kernel = np.empty((3, len(mine))), push(params)
    for k, (at, to) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(mine)])):
        met = np.concatenate([around[:, b:e] for b, e in zip(begin[k], end[k]) if b < e], axis=1)
        force[:, at:to] = dense_forces(kernel, nodes[:, at:to], met)[0]
    out = np.empty_like(force)
    out[:, sorted_by_cube] = force
    return out


def _step(own: pa.Table, other: pa.Table, params: Params) -> pa.Table:
    """One block one step further."""
    if not own.num_rows:  # a part of a crowded cell that got no node
        return _TYPES.empty_table()
    mine = _columns(own)
    guests = _columns(other) if other.num_rows else {c: mine[c][:0] for c in ("id", *AXES, "m")}
    near = {c: np.concatenate([mine[c], guests[c]]) for c in ("id", *AXES, "m")}
    force = _repelled(mine, near, params)
    ends, weight = [_values(own, c) for c in ("own", "other")], _values(own, "weight")
    if len(weight):
        order = np.argsort(near["id"], kind="stable")
        ids = near["id"][order]
        i, j = (order[np.searchsorted(ids, e)] for e in ends)
        d = [near[a][j] - near[a][i] for a in AXES]
        pull = np.where(d[0] * d[0] + d[1] * d[1] + d[2] * d[2] >= 0.0001, params.spring * weight, 0.0)
        for k in range(3):
            force[k] += np.bincount(i, d[k] * pull, len(mine["id"]))[: len(mine["id"])]
    for k, a in enumerate(AXES):
        mine[f"v{a}"] = mine[f"v{a}"] * params.damping + force[k] * params.time_step
        mine[a] = mine[a] + mine[f"v{a}"] * params.time_step
    moved = np.sqrt(sum((mine[a] - mine[f"{a}0"]) ** 2 for a in AXES))
    return _written(own["block"][0].as_py(), mine, own, float(moved.max()))


def run_in_blocks(nodes: DataFrame, edges: DataFrame, params: Params, steps: int, **options) -> DataFrame:
    """The same as run_steps. Edges of a node meet in its block: with a node of more than MOST_EDGES of them, run_steps does the work.

    Edges with an unknown end pull nothing; nodes without a position must have been placed before.
    """
    edges = settled(edges.select("source", "target", "weight"), "layout-links")
    ends = edges.select(F.col("source").alias("id")).unionAll(edges.select(F.col("target").alias("id")))
    if (ends.groupBy("id").count().agg(F.max("count")).first()[0] or 0) > MOST_EDGES:
        return run_steps(nodes, edges, params, steps)
    if not steps or nodes.isEmpty():
        return nodes
    with shuffles_removed(nodes.sparkSession):
        return BlockLayout(nodes, edges, params, **options).advance(steps).nodes(nodes)
