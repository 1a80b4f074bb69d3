"""Forces between many nodes, by blocks of space between which the force has one simple form."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np

#: Nodes of a block, and nodes that meet a block at once: two arrays of that size stay in a core's cache.
BLOCK, _MEET = 256, 256
#: A box's bounds are widened by this share, so that rounding puts no pair on the wrong side of a piece's end.
_MARGIN = 1e-9
#: A block this many times wider than its distance from others would lose digits in a product of matrices.
_WIDE = 16.0

#: rest(targets, sources, both): the forces of any pairs, whatever their distances.
Rest = Callable[[np.ndarray, np.ndarray, bool], tuple[np.ndarray, np.ndarray | None]]


class Piece(NamedTuple):
    """For distances between low and high the force is weight * form(squared distance, distance); both arrays are free to be overwritten."""

    low: float
    high: float
    weight: float
    form: Callable[[np.ndarray, np.ndarray], np.ndarray]
    #: The distance at which the form jumps: pairs as near to it as rounding needs are told by differences of coordinates.
    jump: float | None = None


def blocks(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, begins and end): points (3 rows) halved along their widest axis until a block has at most BLOCK of them."""
    parts, done = [np.arange(place.shape[1])], []
    while parts:
        rows = parts.pop()
        if len(rows) <= BLOCK:
            done.append(rows)
            continue
        at = place[:, rows]
        half = max(1, round(len(rows) / BLOCK / 2)) * BLOCK
        cut = np.argpartition(at[np.argmax(at.max(1) - at.min(1))], half)
        parts += [rows[cut[half:]], rows[cut[:half]]]
    return np.concatenate(done), np.cumsum([0, *map(len, done)])


def _squares(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, from differences."""
    d = [other[k] - one[k][:, None] for k in range(3)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def forces_by_pieces(pieces: list[Piece], rest: Rest, targets: np.ndarray, sources: np.ndarray, both: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """(force on each target from all sources, if both the force on each source from all targets): 3 rows each, for rows x, y, z and mass.

    Targets are taken by blocks. A source whose distances to the whole box of a block lie inside a piece gets its form; the first piece that fits counts,
    and sources that no piece fits are left to rest. Every pair is met, by one or the other.
    """
    if not (targets.size and sources.size and np.isfinite(targets).all() and np.isfinite(sources).all()):
        return rest(targets, sources, both)
    order, begins = blocks(targets[:3])
    targets = targets[:, order]
    low, high = (f.reduceat(targets[:3], begins[:-1], axis=1) for f in (np.minimum, np.maximum))
    force, back = np.zeros((3, len(order))), np.zeros(sources[:3].shape)
    space = np.empty((2, BLOCK * _MEET))
    for b, (at, to) in enumerate(zip(begins[:-1], begins[1:])):
        lo, hi = low[:, b : b + 1], high[:, b : b + 1]
        beyond, before = sources[:3] - lo, hi - sources[:3]
        gap, span = np.maximum(-np.minimum(beyond, before), 0.0), np.maximum(beyond, before)
        nearest, farthest = np.sqrt((gap * gap).sum(0)) * (1.0 - _MARGIN), np.sqrt((span * span).sum(0)) * (1.0 + _MARGIN)
        compact = np.sqrt(((hi - lo) ** 2).sum()) <= _WIDE * nearest
        fit = np.full(sources.shape[1], len(pieces), np.int8)
        for k in reversed(range(len(pieces))):
            fit[compact & (nearest > pieces[k].low) & (farthest < pieces[k].high)] = k
        rows = np.argsort(fit, kind="stable")
        ends = np.searchsorted(fit[rows], np.arange(len(pieces) + 2))
        met = rows[: ends[-2]]

        centre = (lo + hi) / 2.0
        own, mass = targets[:3, at:to] - centre, targets[3, at:to]
        place, weight = sources[:3, met] - centre, sources[3, met]
        one = np.stack([*(-2.0 * own), (own * own).sum(0), np.ones(to - at)], axis=1)  # times the next: squared distances
        two = np.stack([*place, np.ones(len(met)), (place * place).sum(0)])
        right, left = np.stack([*(place * weight), weight], axis=1), np.stack([*(own * mass), mass])
        out, mirrored = np.zeros((to - at, 4)), np.empty((4, len(met)))
        for piece, first, last in zip(pieces, ends[:-2], ends[1:-1]):
            for u in range(first, last, _MEET):
                v = min(u + _MEET, last)
                square, distance = (s[: (to - at) * (v - u)].reshape(to - at, v - u) for s in space)
                np.dot(one, two[:, u:v], out=square)
                np.sqrt(square, out=distance)
                if piece.jump and np.count_nonzero(distance < piece.jump * (1.0 - _MARGIN)) < np.count_nonzero(distance < piece.jump * (1.0 + _MARGIN)):
                    square[:] = _squares(targets[:3, at:to], sources[:3, met[u:v]])
                    np.sqrt(square, out=distance)
                factor = piece.form(square, distance)
                out += piece.weight * np.dot(factor, right[u:v])
                if both:
                    mirrored[:, u:v] = piece.weight * np.dot(left, factor)
        force[:, at:to] += (out[:, :3].T - own * out[:, 3]) * mass
        if both:
            back[:, met] += (mirrored[:3] - place * mirrored[3]) * weight
        if len(met) < len(rows):
            forces, opposite = rest(targets[:, at:to], sources[:, rows[ends[-2] :]], both)
            force[:, at:to] += forces
            if both:
                back[:, rows[ends[-2] :]] += opposite
    force[:, order] = force.copy()
    return force, back if both else None
