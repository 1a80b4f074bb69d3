"""Force-directed layout steps and geometry of positions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import exprs as X
from loomgraph.operators.pieces import Piece, forces_by_pieces
from loomgraph.operators.ranking import numbered
from loomgraph.sources.tables import discarded, settled

AXES = ["x", "y", "z"]
#: Nodes of one tile side; where all nodes meet by blocks of space, tiles are larger, so that nodes are copied less and blocks meet more at once.
TILE, WIDE_TILE = 1024, 6144


@dataclass(frozen=True)
class Params:
    """Simulation parameters; bounds of None switch the boundary off."""

    repulsion: float = 0.1
    spring: float = 0.2
    damping: float = 0.95
    reach: float = 2.0
    mass_scale: float = 1.0
    time_step: float = 0.016
    bounds: float | None = 15.0
    iterations: int = 100

    @classmethod
    def phase(cls, name: str) -> "Params":
        """Presets of the initial, dynamic and final phase."""
        # Fixed values of the three phases.
        presets = {
            "initial": dict(iterations=300, time_step=0.2, spring=0.3, repulsion=200.0, reach=800.0, mass_scale=1.2, damping=0.95),
            "dynamic": dict(iterations=50, time_step=0.2, spring=0.5, repulsion=100.0, reach=500.0, mass_scale=1.0, damping=0.5),
            "finalize": dict(iterations=200, time_step=0.2, spring=0.1, repulsion=50.0, reach=300.0, mass_scale=0.8, damping=0.95),
        }
        return replace(cls(bounds=1000.0), **presets[name])


def on_sphere(nodes: DataFrame, order: str = "metadata_id", radius: float = 3.0, spread: float = 0.0, seed: int = 0) -> DataFrame:
    """nodes placed evenly on a sphere in the given order, at rest; spread varies the radius by a seeded hash."""
    total = nodes.count()
    rows = numbered(nodes, order, name="_i")
    r = radius * (1.0 + spread * (F.pmod(F.xxhash64(F.lit(seed), F.col(order)), F.lit(2001)) / 1000.0 - 1.0))
    points = X.sphere_point(F.col("_i"), F.lit(float(max(total, 1))), 1.0)
    return rows.select(*nodes.columns, *((p * r).alias(c) for c, p in points.items()), *(F.lit(0.0).alias(f"v{c}") for c in AXES))


#: kernel(squared distance, distance) of pairs -> factor of their difference for masses of 1; nothing at distance 0. Both arrays are free to be overwritten.
Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Pairs that are held as arrays at once, and rows gathered before they are paired.
_PAIRS, _GATHER = 1 << 19, 4096
#: Tiles of at least so many pairs are matrices, of which so many entries are held at once.
_DENSE, _ENTRIES = 1 << 12, 1 << 15
#: Tiles of at least so many pairs are met by blocks of space, where the force has pieces.
_BLOCKED = 1 << 18
#: A group has at most so many tiles on a side, so that no node is copied more often than that. Pairs of one task, and the most tasks.
MOST_TILES, _TASK_PAIRS, _MOST_TASKS = 64, 1 << 25, 1024


def _dealt(targets: DataFrame, sources: DataFrame, keys: list[str], cols: list[str], tile: int) -> DataFrame:
    """Targets and sources of each group dealt to its tiles (a, b): about tile rows of either; tiles are keys of the shuffle."""
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    blocks = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(name))
    side = F.greatest(F.lit(float(tile)), F.sqrt(F.col("_t") * F.col("_s")) / (MOST_TILES / 4))  # at most (MOST_TILES / 4) ** 2 tiles and some
    sizes = blocks(targets, "_t").join(blocks(sources, "_s"), keys)
    parts = _parts(targets.sparkSession, sizes.agg(F.sum(F.col("_t") * F.col("_s"))).first()[0] or 0.0)
    sizes = sizes.select(*keys, *(F.ceil(F.col(c) / side).cast("int").alias(n) for c, n in (("_t", "nt"), ("_s", "ns"))))
    placed = lambda df: _with_crowded(df, sizes.filter("nt > 1 OR ns > 1"), keys).fillna(1, ["nt", "ns"])
    left = placed(targets).select(*keys, own(F.col("nt")).alias("a"), every(F.col("ns")).alias("b"), F.lit(True).alias("target"), *cols)
    right = placed(sources).select(*keys, every(F.col("nt")).alias("a"), own(F.col("ns")).alias("b"), F.lit(False).alias("target"), *cols)
    return left.unionAll(right).repartition(*parts, *keys, "a", "b").sortWithinPartitions(*keys, "a", "b", "target")


def _with_crowded(rows: DataFrame, crowded: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the sizes of their group if it is a crowded one, null otherwise. A shuffle by group would put the rows of a crowded one into one
    task, and copy them there; of crowded groups there are few (one per tile of nodes at most), so their sizes go to every task.
    """
    return rows.dropna(subset=keys).join(F.broadcast(crowded), keys, "left")


def _parts(spark: SparkSession, pairs: float) -> list[int]:
    """The number of partitions where the pairs need more than the session's; tiles are small next to the work in them, so sizes in bytes say little."""
    wanted = int(min(pairs / _TASK_PAIRS, _MOST_TASKS))
    return [wanted] if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else []


def _pairs(group: np.ndarray, target: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(target rows, source rows) of all pairs inside each group, a bounded number at a time; rows are sorted by group, sources first."""
    t, s = np.flatnonzero(target), np.flatnonzero(~target)
    counts = np.bincount(group[s], minlength=int(group[-1]) + 1)
    begins = np.cumsum(counts) - counts
    many, first = counts[group[t]], begins[group[t]]
    ends = np.cumsum(many)
    at = 0
    while at < len(t):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, side="right")))
        own = many[at:end]
        shift = np.repeat(first[at:end] - (np.cumsum(own) - own), own)
        yield np.repeat(t[at:end], own), s[shift + np.arange(len(shift))]
        at = end


def _per_group(tiles: DataFrame, keys: list[str], schema: str, work: Callable[[dict[str, np.ndarray], np.ndarray], Iterator[list[np.ndarray]]]) -> DataFrame:
    """What work(columns, number of each row's group) gives for whole groups of rows with equal keys; many small groups are handed over in one go."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def numbers(columns: dict[str, np.ndarray]) -> np.ndarray:
        change = np.zeros(len(columns[keys[0]]), bool)
        for c in keys:
            change[1:] |= columns[c][1:] != columns[c][:-1]
        return np.cumsum(change)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            columns = {c: rows[c].to_numpy() for c in rows.column_names}
            for out in work(columns, numbers(columns)):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], names)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= _GATHER:
                rows = pa.Table.from_batches(held)
                number = numbers({c: rows[c].to_numpy() for c in keys})
                cut = int(np.searchsorted(number, number[-1]))  # the last group may go on
                if cut:
                    yield from done(rows.slice(0, cut))
                    held = rows.slice(cut).to_batches()
        if any(b.num_rows for b in held):
            yield from done(pa.Table.from_batches(held))

    return tiles.mapInArrow(run, schema)


def _per_target(tiles: DataFrame, keys: list[str], schema: str, kernel: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], list[np.ndarray]]) -> DataFrame:
    """(id, sums over its pairs) of each target of each tile; many small tiles are paired in one go, a large one in parts."""

    def work(columns: dict[str, np.ndarray], number: np.ndarray) -> Iterator[list[np.ndarray]]:
        target, n = columns["target"].astype(bool), len(number)
        sums = None
        for i, j in _pairs(number, target):
            parts = [np.bincount(i, v, n) for v in kernel(columns, i, j)]
            sums = parts if sums is None else [a + b for a, b in zip(sums, parts)]
        if sums is not None:
            yield [columns["id"][target], *(v[target] for v in sums)]

    return _per_group(tiles, [*keys, "a", "b"], schema, work)


def dense_forces(kernel: Kernel, targets: np.ndarray, sources: np.ndarray, both: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """(force on each target from all sources, if both the force on each source from all targets): 3 rows each, for rows x, y, z and mass.

    Pairs are entries of a matrix, a bounded number at a time; sums over them are products of matrices.
    """

    def moments(side: np.ndarray) -> np.ndarray:
        place = np.nan_to_num(side[:3] - start, nan=0.0, posinf=0.0, neginf=0.0)  # a node without a place exerts nothing
        return np.concatenate([place * side[3], side[3:4]]).T

    start = np.nan_to_num(targets[:3, :1])  # near the origin sums lose least
    right, left = moments(sources), moments(targets)
    out = np.empty((targets.shape[1], 4))
    back = np.zeros((sources.shape[1], 4)) if both else None
    step = max(1, _ENTRIES // max(sources.shape[1], 1))
    for low in range(0, len(out), step):
        own = targets[:, low : low + step, None]
        square = sources[0] - own[0]
        square *= square
        other = sources[1] - own[1]
        other *= other
        square += other
        np.subtract(sources[2], own[2], out=other)
        other *= other
        square += other
        factor = kernel(square, np.sqrt(square, out=other))
        np.dot(factor, right, out=out[low : low + step])
        if back is not None:
            back += factor.T @ left[low : low + step]

    def forces(sums: np.ndarray, side: np.ndarray) -> np.ndarray:
        place = np.nan_to_num(side[:3] - start, nan=0.0, posinf=0.0, neginf=0.0)
        return (sums[:, :3].T - place * sums[:, 3]) * side[3]

    return forces(out, targets), None if back is None else forces(back, sources)


def _tiled(nodes: DataFrame, kernel: Kernel, tile: int, reach: float | None = None, pieces: list[Piece] | None = None) -> DataFrame:
    """(id, fx, fy, fz): sum of kernel(distance) times both masses times the difference, over all other nodes, or those of the 27 grid cells of side reach around.

    Forces are opposite and equal, so each pair is met once: inside a cell, or from a cell to the 13 cells that come after it.
    Groups are cut into tiles, so that a crowded group is many tasks, and no node has more than about MOST_TILES copies of a kind.
    With pieces (of all pairs), tiles hold nodes that lie together, so that most blocks of them have one piece between them.
    """
    cols = ["id", *AXES, "m"]
    keys = [f"c{c}" for c in AXES]
    if reach:
        cells = nodes.select(*cols, *(F.floor(F.col(c) / reach).alias(k) for c, k in zip(AXES, keys)))
        count = cells.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("_n"))
        parts = _parts(nodes.sparkSession, count.agg(F.sum(F.col("_n") * F.col("_n"))).first()[0] or 0.0)
        placed = _with_crowded(cells, count.filter(F.col("_n") > tile), keys)
        tiles = F.coalesce(F.least(F.ceil(F.col("_n") / tile), F.lit(MOST_TILES)), F.lit(1)).cast("int")
    else:  # one group: its number of tiles is a plain value
        keys, cells, n = [], nodes.select(*cols), nodes.count()
        parts = _parts(nodes.sparkSession, float(n) * n)
        most = max(1, min(-(-n // tile), MOST_TILES))
        placed, tiles = cells, F.lit(most)
    part = F.pmod(F.xxhash64("id"), tiles).cast("int")
    if pieces and not reach and most > 1:
        placed = numbered(cells.withColumn("_c", _curve(cells)), "_c", "id", name="_r")
        part = F.floor(F.col("_r") * most / n).cast("int")
        parts = [min(p, most * (most + 1) // 2) for p in parts]  # a task without a tile only costs its start
    inside = placed.withColumns({"_p": part, "_q": F.explode(F.sequence(F.lit(0), tiles - 1))})
    inside = inside.select(*keys, F.least("_p", "_q").alias("a"), F.greatest("_p", "_q").alias("b"), (F.col("_p") <= F.col("_q")).alias("target"), F.lit(True).alias("same"), *cols)
    groups = [*keys, "same", "a", "b"]
    dealt = inside.repartition(*parts, *groups).sortWithinPartitions(*groups, "target")
    found = [_per_group(dealt, groups, "id long, fx double, fy double, fz double", _met(kernel, pieces))]
    if reach:
        after = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) > (0, 0, 0)]
        step = F.explode(F.array(*(F.struct(*(F.lit(k).alias(c) for k, c in zip(o, AXES))) for o in after)))
        guests = cells.withColumn("_o", step).select(*cols, *((F.col(k) - F.col("_o")[c]).alias(k) for k, c in zip(keys, AXES)))
        across = _dealt(cells, guests, keys, [F.lit(False).alias("same"), *cols], tile)
        found.append(_per_group(across, groups, "id long, fx double, fy double, fz double", _met(kernel)))
    both = found[0] if len(found) == 1 else found[0].unionAll(found[1])
    return both.groupBy("id").agg(*(F.sum(f"f{c}").alias(f"f{c}") for c in AXES))


def _curve(nodes: DataFrame) -> Column:
    """The place of each node along a curve through space (Morton order of 1,024 steps an axis); nodes without a place are at its start."""
    finite = lambda c: F.when(X.is_finite(F.col(c)), F.col(c))
    box = nodes.agg(*(f(finite(c)).alias(f"{n}{c}") for c in AXES for n, f in (("lo", F.min), ("hi", F.max)))).first()
    code = F.lit(0)
    for k, c in enumerate(AXES):
        low, high = box[f"lo{c}"] or 0.0, box[f"hi{c}"] or 0.0
        step = F.coalesce(((finite(c) / 2.0 - low / 2.0) / max(high / 2.0 - low / 2.0, 1e-300) * 1023.0).cast("int"), F.lit(0))
        for by, mask in ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):  # two free bits behind each
            step = step.bitwiseOR(F.shiftleft(step, by)).bitwiseAND(F.lit(mask))
        code = code.bitwiseOR(F.shiftleft(step, k))
    return code


def _met(kernel: Kernel, pieces: list[Piece] | None = None) -> Callable[[dict[str, np.ndarray], np.ndarray], Iterator[list[np.ndarray]]]:
    """Forces of both sides of each tile; a tile of a cell's part with itself has one side only."""

    def plain(targets: np.ndarray, sources: np.ndarray, both: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        return dense_forces(kernel, targets, sources, both)

    def blocked(targets: np.ndarray, sources: np.ndarray, both: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        return forces_by_pieces(pieces, plain, targets, sources, both)

    def work(columns: dict[str, np.ndarray], number: np.ndarray) -> Iterator[list[np.ndarray]]:
        target, n = columns["target"].astype(bool), len(number)
        alone = columns["same"].astype(bool) & (columns["a"] == columns["b"])
        place = np.stack([columns[c] for c in (*AXES, "m")]).astype(float)
        begins = np.searchsorted(number, np.arange(number[-1] + 2))
        many = np.bincount(number, target, number[-1] + 1).astype(np.int64)
        single = alone[begins[:-1]]
        pairs = np.where(single, many * many, many * (np.diff(begins) - many))
        force = np.zeros((3, n))
        for g in np.flatnonzero(pairs >= _DENSE).tolist():
            low, middle, high = begins[g], begins[g + 1] - many[g], begins[g + 1]
            meet = blocked if pieces and pairs[g] >= _BLOCKED else plain
            if single[g]:
                force[:, low:high] = meet(place[:, low:high], place[:, low:high])[0]
            else:
                force[:, middle:high], force[:, low:middle] = meet(place[:, middle:high], place[:, low:middle], both=True)
        few = (pairs < _DENSE)[number]
        for chosen, mirrored in ((few & single[number], False), (few & ~single[number], True)):
            rows = np.flatnonzero(chosen)
            if not len(rows):
                continue
            if mirrored:
                met = _pairs(number[rows], target[rows])
            else:  # every row is both sides
                twice = np.concatenate([number[rows], number[rows]])
                order = np.argsort(twice * 2 + (np.arange(len(twice)) >= len(rows)), kind="stable")
                met = ((order[i] % len(rows), order[j] % len(rows)) for i, j in _pairs(twice[order], order >= len(rows)))
            for i, j in met:
                i, j = rows[i], rows[j]
                d = place[:3, j] - place[:3, i]
                square = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
                factor = kernel(square, np.sqrt(square)) * place[3, i] * place[3, j]
                d = np.where(factor == 0.0, 0.0, d)  # a node without a place exerts nothing
                for k in range(3):
                    force[k] += np.bincount(i, d[k] * factor, n)
                    if mirrored:
                        force[k] -= np.bincount(j, d[k] * factor, n)
        yield [columns["id"], *force]

    return work


def _in_cells(nodes: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """(targets in their grid cell, sources in that cell and its 26 neighbours)."""
    cells = [F.floor(F.col(c) / size).alias(f"c{c}") for c in AXES]
    targets = nodes.select("*", *cells)
    sources = targets
    for c in AXES:
        sources = sources.withColumn(f"c{c}", F.explode(F.array(*(F.col(f"c{c}") + k for k in (-1, 0, 1)))))
    return targets, sources


def spring_forces(nodes: DataFrame, edges: DataFrame, strength: float) -> DataFrame:
    """(id, fx, fy, fz) of every edge end, pulled towards the other end by strength * weight * distance."""
    a = nodes.select(F.col("id").alias("source"), *(F.col(c).alias(f"{c}1") for c in AXES))
    b = nodes.select(F.col("id").alias("target"), *(F.col(c).alias(f"{c}2") for c in AXES))
    d = {c: F.col(f"{c}2") - F.col(f"{c}1") for c in AXES}
    square = d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"]
    both = edges.join(a, "source").join(b, "target").filter(square >= 0.0001)
    pull = {c: d[c] * F.lit(strength) * F.col("weight") for c in AXES}
    forces = both.select("source", "target", *(pull[c].alias(f"f{c}") for c in AXES))
    ends = forces.select(F.col("source").alias("id"), *(f"f{c}" for c in AXES)).unionAll(
        forces.select(F.col("target").alias("id"), *((-F.col(f"f{c}")).alias(f"f{c}") for c in AXES))
    )
    return ends.groupBy("id").agg(*(F.sum(f"f{c}").alias(f"f{c}") for c in AXES))


def push(params: Params) -> Kernel:
    """Repulsion within reach."""

    def kernel(square: np.ndarray, distance: np.ndarray) -> np.ndarray:
        off = ~((square >= 0.0001) & (distance <= params.reach))
        square *= distance
        np.copyto(square, np.inf, where=off)
        return np.divide(-params.repulsion, square, out=square)

    return kernel


def edge_mass(params: Params) -> Column:
    """What the mass of a node counts in the edge model."""
    return F.col("mass") / F.lit(255.0) * 10.0 * params.mass_scale


def edge_step(nodes: DataFrame, edges: DataFrame, params: Params, tile: int = TILE, m: Column | None = None) -> DataFrame:
    """One step with repulsion within reach and springs along edges; all forces precede all moves.

    nodes: id, x, y, z, vx, vy, vz, and mass unless m is given. Only nodes of neighbouring grid cells are compared.
    """
    slim = nodes.select("id", *AXES, (edge_mass(params) if m is None else m).alias("m"))

    repelled = _tiled(slim, push(params), tile, params.reach)
    total = repelled.unionByName(spring_forces(nodes, edges, params.spring)).groupBy("id").agg(*(F.sum(f"f{c}").alias(f"f{c}") for c in AXES))
    moved = nodes.join(total, "id", "left")
    for c in AXES:
        moved = moved.withColumn(f"v{c}", F.col(f"v{c}") * params.damping + F.coalesce(f"f{c}", F.lit(0.0)) * params.time_step)
        moved = moved.withColumn(c, F.col(c) + F.col(f"v{c}") * params.time_step)
    return moved.select(*nodes.columns)


def run_steps(nodes: DataFrame, edges: DataFrame, params: Params, steps: int) -> DataFrame:
    """Several steps; each is written to the shared folder, so the plan doesn't grow, and the step before it removed."""
    before = None
    for _ in range(steps - 1):
        nodes = settled(edge_step(nodes, edges, params), "layout")
        discarded(before)
        before = nodes
    return edge_step(nodes, edges, params) if steps else nodes


# Fixed values of the all-pairs model.
MAX_FORCE, MAX_VELOCITY, MIN_DISTANCE, WARMUP = 3.0, 0.02, 0.15, 100


def all_pairs_act(params: Params, iteration: int) -> tuple[float, Kernel]:
    """(how much of the spring is on, the force between two nodes of mass 1): repulsion below reach, attraction beyond it."""
    ramp = 0.01 + 0.99 * iteration / WARMUP if iteration < WARMUP else 1.0

    def act(square: np.ndarray, distance: np.ndarray) -> np.ndarray:
        on = distance > MIN_DISTANCE
        np.fmax(distance, MIN_DISTANCE, out=distance)
        spring = np.maximum(distance, 3.0)
        spring -= 3.0
        spring *= 0.1 * params.spring * ramp
        spring += params.spring * ramp
        spring *= distance - 1.0
        np.maximum(square, MIN_DISTANCE, out=square)
        repel = np.maximum(np.divide(-params.repulsion, square, out=square), -2.0 * params.repulsion, out=square)
        np.copyto(spring, repel, where=distance < params.reach)
        spring /= distance
        np.copyto(spring, 0.0, where=~on)
        return spring

    return ramp, act


def all_pairs_pieces(params: Params, iteration: int) -> list[Piece]:
    """The force of all_pairs_act where distances lie in a range that makes it simple; none for parameters that turn it round."""
    ramp, _ = all_pairs_act(params, iteration)
    spring, push, reach = params.spring * ramp, -params.repulsion, params.reach
    if push > 0.0 or reach <= MIN_DISTANCE:
        return []
    flat = max(MIN_DISTANCE, 0.5)  # nearer than its root repulsion has its cap

    def far(square: np.ndarray, distance: np.ndarray) -> np.ndarray:
        square -= 7.0
        square /= distance
        square += 6.0
        return square

    def middle(square: np.ndarray, distance: np.ndarray) -> np.ndarray:
        np.divide(-1.0, distance, out=square)
        square += 1.0
        return square

    def beyond(square: np.ndarray, distance: np.ndarray) -> np.ndarray:
        middle(square, distance)
        np.maximum(distance, 3.0, out=distance)
        distance += 7.0
        square *= distance
        return square

    def within(square: np.ndarray, distance: np.ndarray) -> np.ndarray:
        square *= distance
        return np.divide(1.0, square, out=square)

    def near(square: np.ndarray, distance: np.ndarray) -> np.ndarray:
        return within(np.maximum(square, flat, out=square), distance)

    def either(inside: np.ndarray, pushed: np.ndarray, pulled: np.ndarray) -> np.ndarray:
        pushed -= pulled
        pushed *= inside
        pushed += pulled
        return pushed

    def across_middle(square: np.ndarray, distance: np.ndarray) -> np.ndarray:
        inside = distance < reach
        square *= distance
        np.divide(push, square, out=square)
        np.divide(-spring, distance, out=distance)
        distance += spring
        return either(inside, square, distance)

    def across(square: np.ndarray, distance: np.ndarray) -> np.ndarray:
        inside, stretched = distance < reach, np.maximum(distance, 3.0)
        near(square, distance)
        square *= push
        np.divide(-0.1 * spring, distance, out=distance)
        distance += 0.1 * spring
        stretched += 7.0
        distance *= stretched
        return either(inside, square, distance)

    return [
        Piece(max(reach, 3.0), np.inf, 0.1 * spring, far),
        Piece(reach, 3.0, spring, middle),
        Piece(np.sqrt(flat), reach, push, within),
        Piece(reach, np.inf, 0.1 * spring, beyond),
        Piece(MIN_DISTANCE, reach, push, near),
        Piece(np.sqrt(flat), 3.0, 1.0, across_middle, reach),
        Piece(MIN_DISTANCE, np.inf, 1.0, across, reach),
    ]


def all_pairs_step(nodes: DataFrame, params: Params, iteration: int, tile: int = WIDE_TILE) -> DataFrame:
    """One step of the all-pairs model: repulsion below reach, attraction beyond it, pull to the centre, caps and bounds.

    nodes: id, x, y, z, vx, vy, vz, mass. Every node acts on every other, in tiles.
    """
    slim = nodes.select("id", *AXES, X.mass_unit(F.col("mass")).alias("m"))
    return all_pairs_move(nodes, all_pairs_forces(slim, params, iteration, tile), params, iteration)


def all_pairs_forces(nodes: DataFrame, params: Params, iteration: int, tile: int = WIDE_TILE) -> DataFrame:
    """(id, fx, fy, fz) for nodes (id, x, y, z, m): the exact sums over all others."""
    return _tiled(nodes, all_pairs_act(params, iteration)[1], tile, pieces=all_pairs_pieces(params, iteration))


def all_pairs_move(nodes: DataFrame, forces: DataFrame, params: Params, iteration: int) -> DataFrame:
    """nodes moved by the forces (id, fx, fy, fz) of all others."""
    warm = min(iteration, WARMUP) / WARMUP
    ramp, _ = all_pairs_act(params, iteration)
    damping = max(params.damping, 0.9 - 0.4 * warm) if iteration < WARMUP else params.damping
    m = X.mass_unit(F.col("mass"))
    rows = nodes.join(forces, "id", "left")
    norm = lambda a, b, c: F.sqrt(a * a + b * b + c * c)
    far = norm(*(F.col(c) for c in AXES))
    centre = F.when(far > 3.0, F.lit(0.015) * m * ramp * (far - 3.0) / far).otherwise(0.0)
    rows = rows.select(*nodes.columns, *((F.coalesce(f"f{c}", F.lit(0.0)) - F.col(c) * centre).alias(f"f{c}") for c in AXES))
    size = norm(*(F.col(f"f{c}") for c in AXES))
    cap = F.when(size > MAX_FORCE, F.lit(MAX_FORCE) / size).otherwise(1.0)
    rest = 0.0 if iteration < 5 else 1.0
    rows = rows.select(*(c for c in nodes.columns if c[0] != "v"), *(
        (F.col(f"v{c}") * rest * (1.0 - damping) + F.least(F.lit(MAX_FORCE), F.greatest(F.lit(-MAX_FORCE), F.col(f"f{c}") * cap)) * params.time_step).alias(f"v{c}")
        for c in AXES
    ))
    speed = norm(*(F.col(f"v{c}") for c in AXES))
    slow = F.when(speed > MAX_VELOCITY, F.lit(MAX_VELOCITY) / speed).otherwise(1.0)
    rows = rows.select(*(c for c in rows.columns if c[0] != "v"), *((F.col(f"v{c}") * slow).alias(f"v{c}") for c in AXES))
    for c in AXES:
        at = F.col(c) + F.col(f"v{c}") * params.time_step
        if params.bounds and iteration > 10:
            out = F.abs(at) > 0.7 * params.bounds
            rows = rows.withColumns({c: F.when(out, at * 0.92).otherwise(at), f"v{c}": F.when(out, F.col(f"v{c}") * 0.85).otherwise(F.col(f"v{c}"))})
        else:
            rows = rows.withColumn(c, at)
    return rows.select(*nodes.columns)


def easing_tick(nodes: DataFrame, spring: float, damping: float, threshold: float, dt: float) -> DataFrame:
    """Pull current towards target positions (tx, ty, tz); settled nodes rest; pinned nodes stay."""
    d = {c: F.col(f"t{c}") - F.col(c) for c in AXES}
    settled_node = d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"] < threshold * threshold
    moving = ~F.col("pinned") & ~settled_node
    v = {c: (F.col(f"v{c}") + d[c] * spring * dt) * damping for c in AXES}
    return nodes.withColumns(
        {f"v{c}": F.when(F.col("pinned"), F.col(f"v{c}")).when(settled_node, 0.0).otherwise(v[c]) for c in AXES}
        | {c: F.when(moving, F.col(c) + v[c] * dt).otherwise(F.col(c)) for c in AXES}
    )


def pinned(nodes: DataFrame, id: int, x: float, y: float, z: float) -> DataFrame:
    """One node held at a place: target and current position are set, velocity is 0."""
    place, here = dict(zip(AXES, (x, y, z))), F.col("id") == id
    changes: dict[str, Column] = {"pinned": F.col("pinned") | here}
    for c in AXES:
        changes |= {c: F.when(here, place[c]).otherwise(F.col(c)), f"t{c}": F.when(here, place[c]).otherwise(F.col(f"t{c}")), f"v{c}": F.when(here, 0.0).otherwise(F.col(f"v{c}"))}
    return nodes.withColumns(changes)


def jittered(nodes: DataFrame, amplitude: float = 0.05, seed: int = 0) -> DataFrame:
    """Each coordinate moved by up to amplitude, by a seeded hash of the id."""
    shift = lambda c: (F.pmod(F.xxhash64("id", F.lit(c), F.lit(seed)), F.lit(20001)) / 10000.0 - 1.0) * amplitude
    return nodes.withColumns({c: F.col(c) + shift(c) for c in AXES})


def off_origin(nodes: DataFrame, radius: float = 10.0, seed: int = 0) -> DataFrame:
    """Nodes at the origin or without a position go to a seeded place on a sphere."""
    luck = lambda k: F.pmod(F.xxhash64("id", F.lit(k), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    tilt, turn = F.acos(F.lit(1.0) - luck("tilt") * 2.0), luck("turn") * (2.0 * np.pi)
    place = {"x": F.sin(tilt) * F.cos(turn), "y": F.sin(tilt) * F.sin(turn), "z": F.cos(tilt)}
    lost = F.lit(True)
    for c in AXES:
        lost = lost & (F.coalesce(F.col(c), F.lit(0.0)) == 0.0)
    return nodes.withColumns({c: F.when(lost, place[c] * radius).otherwise(F.col(c)) for c in AXES})


def bounding_box(nodes: DataFrame) -> DataFrame:
    """Centre and extent of all nodes; the size is at least 1, and 50 without nodes."""
    box = nodes.agg(*(f(c).alias(f"{n}_{c}") for c in AXES for n, f in (("lo", F.min), ("hi", F.max))))
    extent = {c: F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in AXES}
    return box.select(
        *(((F.col(f"hi_{c}") + F.col(f"lo_{c}")) / 2.0).alias(f"centre_{c}") for c in AXES),
        F.when(F.col("lo_x").isNull(), 50.0).otherwise(F.greatest(*extent.values(), F.lit(1.0))).alias("size"),
    )


def edge_geometry(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends' positions and their length; edges with an unknown end drop out."""
    a = nodes.select(F.col("id").alias("source"), *(F.col(c).alias(f"{c}1") for c in AXES))
    b = nodes.select(F.col("id").alias("target"), *(F.col(c).alias(f"{c}2") for c in AXES))
    d = [F.col(f"{c}2") - F.col(f"{c}1") for c in AXES]
    return edges.join(a, "source").join(b, "target").withColumn("length", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))


def neighbour_counts(nodes: DataFrame, radius: float, tile: int = TILE) -> DataFrame:
    """(id, n): other nodes within radius of each node, by grid cells and tiles."""
    slim = nodes.select("id", *AXES, F.lit(1.0).alias("m"))
    targets, sources = _in_cells(slim, radius)
    keys = ["cx", "cy", "cz"]

    def close(columns: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
        d = [columns[c][j] - columns[c][i] for c in AXES]
        return [((d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= radius * radius) & (columns["id"][i] != columns["id"][j])).astype(float)]

    parts = _per_target(_dealt(targets, sources, keys, ["id", *AXES], tile), keys, "id long, n double", close)
    return parts.groupBy("id").agg(F.sum("n").cast("long").alias("n"))
