"""The all-pairs forces with far nodes taken together: an octree of moments, and a bound for what that leaves out.

Beyond a distance of 3 the force between two nodes is m m' g (0.1 d + 0.6 - 0.7 / d) times their difference, smooth enough to be expanded
around a cell's centre of mass, here with moments up to the fourth. A cell acts as a whole on the nodes whose own cell is not beside it while their
parents are; each level of the tree is one join by parent cells, so the work grows as n log n where the density stays. Nodes in neighbouring leaf
cells are met one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import exprs as X
from loomgraph.operators.layout import AXES, TILE, Kernel, Params, _dealt, _per_group, _per_target, _tiled, all_pairs_act, all_pairs_move, dense_forces
from loomgraph.sources.tables import settled

#: Least side of a leaf cell: up to here the force has kinks.
KINK = 3.0
#: Moments are kept up to this order, since near the middle the forces of all cells nearly cancel, and what an expansion leaves out does not.
ORDER = 4
#: Powers (i, j, k) of x, y, z by order, and the columns of their moments.
_POWERS = [[p for p in product(range(n, -1, -1), repeat=3) if sum(p) == n] for n in range(ORDER + 1)]
_NAMES = {p: "s%d%d%d" % p for powers in _POWERS for p in powers}
_SUMS = list(_NAMES.values())
#: What the fifth derivatives of d times a difference, and of a difference through d, are at most at distance 1, through 5!.
_FIFTH = (0.125, 0.375)


def _shifted(by: list[str]) -> list[str]:
    """The moments of points moved by some values, as SQL."""
    out = []
    for whole, name in _NAMES.items():
        terms = []
        for old in product(*(range(w + 1) for w in whole)):
            ways = float(np.prod([comb(w, o) for w, o in zip(whole, old)]))
            terms.append(" * ".join([f"{ways}D", _NAMES[old], *(v for v, w, o in zip(by, whole, old) for _ in range(w - o))]))
        out.append(f"{' + '.join(terms)} AS {name}")
    return out


def _levels(nodes: DataFrame, side: float) -> list[DataFrame]:
    """Cells (cx, cy, cz and the sums of mass times powers of the place in the cell) from the leaves up, until all cells of a level are neighbours."""
    keys = [f"c{c}" for c in AXES]
    level = nodes.select("m", *(F.floor(F.col(c) / side).alias(k) for c, k in zip(AXES, keys)), *AXES)
    level = level.select(*keys, "m", *((F.col(c) - (F.col(k) + 0.5) * side).alias(c) for c, k in zip(AXES, keys)))
    level = level.selectExpr(*keys, *(" * ".join(["m", *(c for c, n in zip(AXES, p) for _ in range(n))]) + f" AS {name}" for p, name in _NAMES.items()))
    out = []
    while True:
        level = settled(level.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in _SUMS)), "octree")
        spread = level.agg(*(F.max(k) - F.min(k) for k in keys)).first()
        if spread[0] is None or max(spread) <= 1:
            return out
        out.append(level)
        half = level.selectExpr(*keys, *_SUMS, *(f"(pmod({k}, 2) - 0.5D) * {side * 2.0 ** (len(out) - 1)}D AS d{c}" for k, c in zip(keys, AXES)))
        level = half.selectExpr(*(f"floor({k} / 2) AS {k}" for k in keys), *_shifted([f"d{c}" for c in AXES]))


def _about_mass(level: DataFrame, width: float) -> DataFrame:
    """Cells with their centre of mass as x, y, z, and moments about it."""
    moved = level.selectExpr("*", *(f"- {_NAMES[p]} / {_NAMES[0, 0, 0]} AS d{c}" for c, p in zip(AXES, _POWERS[1])))
    return moved.selectExpr(*(f"c{c}" for c in AXES), *(f"(c{c} + 0.5D) * {float(width)}D - d{c} AS {c}" for c in AXES), *_shifted([f"d{c}" for c in AXES]))


def _next(p: tuple[int, ...], a: int, by: int = 1) -> tuple[int, ...]:
    return tuple(n + by * (k == a) for k, n in enumerate(p))


def _along(tensor: dict, r: list[np.ndarray]) -> dict:
    """A symmetric tensor (components by powers) times a vector."""
    return {p: sum(r[a] * tensor[_next(p, a)] for a in range(3)) for p in _POWERS[sum(next(iter(tensor))) - 1]}


def _trace(tensor: dict) -> dict:
    return {p: sum(tensor[_next(p, a, 2)] for a in range(3)) for p in _POWERS[sum(next(iter(tensor))) - 2]}


def _cell_forces(strength: float, side: float):
    """Force of a cell's moments on a node, and the bound of its remainder."""

    def kernel(columns: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
        far = np.max([np.abs(columns[f"o{c}"][i] - columns[f"o{c}"][j]) for c in AXES], axis=0) > 1
        i, j, size = i[far], j[far], len(far)
        second, third, fourth = ({p: columns[_NAMES[p]][j] for p in powers} for powers in _POWERS[2:])
        mass = columns[_NAMES[0, 0, 0]][j]
        r = [columns[c][j] - columns[c][i] for c in AXES]
        square = r[0] ** 2 + r[1] ** 2 + r[2] ** 2
        d = np.sqrt(square)
        # the law of the force, and how each of its derivatives by d through d changes: derivatives of the force are sums of these times differences
        law, one = 0.1 * d + 0.6 - 0.7 / d, 1.0 / d
        inner, outer = 0.1 * one, 0.7 * one / square
        d2, d3 = inner + outer, -(inner + 3.0 * outer) / square
        d4, d5 = (3.0 * inner + 15.0 * outer) / square**2, -(15.0 * inner + 105.0 * outer) / square**3
        none = _POWERS[0][0]
        axes = _POWERS[1]
        second_r, third_r, fourth_r = _along(second, r), _along(third, r), _along(fourth, r)
        third_rr, fourth_rr = _along(third_r, r), _along(fourth_r, r)
        fourth_rrr = _along(fourth_rr, r)
        third_trace, fourth_trace = _trace(third), _trace(fourth)
        fourth_trace_r, twice = _along(fourth_trace, r), _trace(fourth_trace)[none]
        along = mass * law
        along += (d3 * _along(second_r, r)[none] + d2 * _trace(second)[none]) / 2.0
        along += (d4 * _along(third_rr, r)[none] + d3 * 3.0 * _along(third_trace, r)[none]) / 6.0
        along += (d5 * _along(fourth_rrr, r)[none] + d4 * 6.0 * _along(fourth_trace_r, r)[none] + d3 * 3.0 * twice) / 24.0
        own = columns["m"][i] * strength
        # no point of the cell is nearer than its side
        near = np.maximum(d - np.sqrt(3.0) * side, side)
        rest = own * np.maximum(twice, 0.0) * np.sqrt(3.0) * side * (0.1 * _FIFTH[0] / near**3 + 0.7 * _FIFTH[1] / near**5)
        out = []
        for value in (*(own * (along * r[k] + d2 * second_r[p] + (d3 * third_rr[p] + d2 * third_trace[p]) / 2.0 + (d4 * fourth_rrr[p] + d3 * 3.0 * fourth_trace_r[p]) / 6.0) for k, p in enumerate(axes)), rest):
            whole = np.zeros(size)
            whole[far] = value
            out.append(whole)
        return out

    return kernel


def tree_forces(nodes: DataFrame, params: Params, iteration: int, side: float = KINK, tile: int = TILE, share: float | None = None) -> DataFrame:
    """(id, fx, fy, fz, bound) for nodes (id, x, y, z, m): the sums over all others, off by no more than bound in length. Nodes without a place feel nothing.

    With a share, no force is off by more than that share of the exact one: nodes whose bound does not say so meet all others one by one.
    """
    if side < max(KINK, params.reach):
        raise ValueError("cells must not be smaller than where the force is smooth")
    ramp, kernel = all_pairs_act(params, iteration)
    placed = reduce(lambda a, b: a & b, (X.is_finite(F.col(c)) for c in AXES))
    lost, nodes = nodes.filter(~placed), nodes.filter(placed)
    near = _tiled(nodes, kernel, tile, side).withColumn("bound", F.lit(0.0))
    total = near.select("id", "fx", "fy", "fz", "bound")
    keys = [f"p{c}" for c in AXES]
    cols = ["id", *AXES, "m", *(f"o{c}" for c in AXES), *_SUMS]
    for k, level in enumerate(_levels(nodes, side)):
        width = side * 2**k
        own = [F.floor(F.col(c) / width) for c in AXES]
        targets = nodes.select("id", *AXES, "m", *(o.alias(f"o{c}") for o, c in zip(own, AXES)), *(F.floor(o / 2).alias(f"p{c}") for o, c in zip(own, AXES)), *(F.lit(0.0).alias(n) for n in _SUMS))
        sources = _about_mass(level, width).select(F.lit(-1).cast("long").alias("id"), *AXES, F.lit(0.0).alias("m"), *(F.col(f"c{c}").alias(f"o{c}") for c in AXES), *_SUMS)
        for c in AXES:
            sources = sources.withColumn(f"p{c}", F.explode(F.array(*(F.floor(F.col(f"o{c}") / 2) + s for s in (-1, 0, 1)))))
        tiles = _dealt(targets, sources, keys, cols, tile)
        total = total.unionAll(_per_target(tiles, keys, "id long, fx double, fy double, fz double, bound double", _cell_forces(params.spring * ramp, width)))
    total = total.unionAll(lost.select("id", *(F.lit(0.0) for _ in range(4)))).groupBy("id").agg(*(F.sum(c).alias(c) for c in ("fx", "fy", "fz", "bound")))
    if share is None:
        return total
    total = settled(total, "tree-forces")
    size = F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy") + F.col("fz") * F.col("fz"))
    sure = F.col("bound") <= share * (size - F.col("bound"))  # the exact force is not smaller than that difference
    again = nodes.join(total.filter(~sure).select("id"), "id", "left_semi")
    return total.filter(sure).unionAll(_one_by_one(again, nodes, kernel, tile))


def _one_by_one(targets: DataFrame, sources: DataFrame, kernel: Kernel, tile: int) -> DataFrame:
    """(id, fx, fy, fz, bound): the exact forces of all sources on some of them."""

    def work(columns: dict[str, np.ndarray], number: np.ndarray) -> Iterator[list[np.ndarray]]:
        target, place = columns["target"].astype(bool), np.stack([columns[c] for c in (*AXES, "m")]).astype(float)
        ends = np.searchsorted(number, np.arange(number[-1] + 2))
        for low, high in zip(ends[:-1], ends[1:]):
            middle = high - np.count_nonzero(target[low:high])
            yield [columns["id"][middle:high], *dense_forces(kernel, place[:, middle:high], place[:, low:middle])[0]]

    one = lambda df: df.select(F.lit(0).alias("g"), "id", *AXES, "m")
    tiles = _dealt(one(targets), one(sources), ["g"], ["id", *AXES, "m"], tile)
    parts = _per_group(tiles, ["g", "a", "b"], "id long, fx double, fy double, fz double", work)
    return parts.groupBy("id").agg(*(F.sum(f"f{c}").alias(f"f{c}") for c in AXES)).withColumn("bound", F.lit(0.0))


def tree_step(nodes: DataFrame, params: Params, iteration: int, side: float = KINK, tile: int = TILE) -> DataFrame:
    """all_pairs_step with far nodes taken together."""
    slim = nodes.select("id", *AXES, X.mass_unit(F.col("mass")).alias("m"))
    return all_pairs_move(nodes, tree_forces(slim, params, iteration, side, tile).drop("bound"), params, iteration)
