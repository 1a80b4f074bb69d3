"""Cover trees over unit vectors and their dual traversal for exact threshold links, in numpy."""

from __future__ import annotations

import numpy as np

#: Slack of the pruning bounds against rounding; links themselves are decided by the cosine.
_SLACK = 1e-6
#: Node pairs of at most so many row pairs are decided at once instead of descending further.
_DIRECT = 1 << 14
#: Rows of the other tree that one product takes.
_WIDE = 1 << 13


class CoverTree:
    """Nested levels with halving radii: a node's first child keeps its centre, all children's
    centres lie further apart than half the node's radius, and radius covers all members."""

    def __init__(self, vectors: np.ndarray):
        self.x = vectors
        self.center: list[int] = []
        self.radius: list[float] = []
        self.members: list[np.ndarray] = []
        self.children: list[list[int]] = []
        everyone = np.arange(len(vectors))
        self.root = self._node(everyone, self._distances(everyone, 0)) if len(vectors) else -1
        self.radii = np.array(self.radius)
        self.sizes = np.array([len(m) for m in self.members], dtype=np.int64)
        self.centers = np.array(self.center, dtype=np.int64)

    def _distances(self, rows: np.ndarray, center: int) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (self.x[rows] @ self.x[center]), 0))

    def _node(self, rows: np.ndarray, far: np.ndarray) -> int:
        """rows[0] is the centre, far the distances to it; nodes are made from the top down."""
        top = self._add(rows, far)
        todo = [(top, far)]
        while todo:
            node, far = todo.pop()
            rows, half = self.members[node], self.radius[node] / 2
            if len(rows) == 1 or self.radius[node] < _SLACK:
                continue
            own, open_, first = self.x[rows], np.ones(len(rows), bool), 0
            while True:
                near = open_ & (far <= half)
                near[first] = True
                found = np.flatnonzero(near)
                child = self._add(rows[found], far[found])
                self.children[node].append(child)
                if len(found) > 1:
                    todo.append((child, far[found]))
                open_[found] = False
                left = np.count_nonzero(open_)
                if not left:
                    break
                if 2 * left < len(rows):  # copy what is left only when it has halved
                    rows, own = rows[open_], own[open_]
                    open_ = np.ones(left, bool)
                first = int(np.argmax(open_))
                far = np.sqrt(np.maximum(2 - 2 * (own @ own[first]), 0))
        return top

    def _add(self, rows: np.ndarray, far: np.ndarray) -> int:
        self.center.append(int(rows[0]))
        self.radius.append(float(far.max()) if len(rows) > 1 else 0.0)
        self.members.append(rows)
        self.children.append([])
        return len(self.center) - 1


def dual_links(a: CoverTree, b: CoverTree, cosine: float, weight_a: np.ndarray, weight_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of a, links of b, groups): the weight of the other tree's rows linked with each row, and which rows are connected.

    Node pairs further apart than threshold and covering radii allow are pruned; pairs that lie
    wholly within the threshold count at once. groups has an entry for each row of a, then of b, equal where links
    connect. a and b may be one tree; then both counts are the same, a row's link with itself is
    among its links, and groups is about a alone.
    """
    links_a, links_b = np.zeros(len(a.x)), np.zeros(len(b.x))
    shift = 0 if a is b else len(a.x)
    groups = np.arange(len(a.x) + (0 if a is b else len(b.x)))

    def joined(*rows: np.ndarray) -> None:
        old = np.unique(np.concatenate([groups[r] for r in rows]))
        if len(old) > 1:
            groups[np.isin(groups, old)] = old[0]

    def whole(ma: np.ndarray, mb: np.ndarray) -> None:
        links_a[ma] += weight_b[mb].sum()
        links_b[mb] += weight_a[ma].sum()
        joined(ma, mb + shift)

    def some(ma: np.ndarray, mb: np.ndarray, exact: np.ndarray) -> None:
        links_a[ma] += exact @ weight_b[mb]
        links_b[mb] += weight_a[ma] @ exact
        for k in np.flatnonzero(exact.any(axis=1)):
            joined(ma[k : k + 1], mb[exact[k]] + shift)

    if a.root < 0 or b.root < 0:
        return links_a, links_b, groups
    reach = float(np.sqrt(2 - 2 * cosine))
    todo = [(a.root, b.root)]
    while todo:
        na, nb = todo.pop()
        ca, cb = a.children[na] or [na], b.children[nb] or [nb]
        ca, cb = np.array(ca), np.array(cb)
        g = a.x[a.centers[ca]] @ b.x[b.centers[cb]].T
        d = np.sqrt(np.maximum(2 - 2 * g, 0))
        both = a.radii[ca][:, None] + b.radii[cb][None, :]
        near = d <= reach + both + _SLACK
        single = both == 0
        hit = near & single & (g >= cosine)
        inside = near & ~single & (d + both <= reach - _SLACK)
        open_ = near & ~single & ~inside
        if hit.any():
            if (a.sizes[ca] > 1).any() or (b.sizes[cb] > 1).any():  # identical vectors in one leaf
                inside |= hit
            else:
                some(a.centers[ca], b.centers[cb], hit)
        if not (inside.any() or open_.any()):
            continue
        below, owner = np.concatenate([b.members[m] for m in cb]), np.repeat(np.arange(len(cb)), b.sizes[cb])
        for i in np.flatnonzero(inside.any(axis=1)):
            whole(a.members[ca[i]], below[inside[i][owner]])
        splits_b = np.array([bool(b.children[m]) for m in cb])
        for i in np.flatnonzero(open_.any(axis=1)):
            ma = a.members[ca[i]]
            descend = open_[i] & (len(ma) * b.sizes[cb] > _DIRECT) & (splits_b | bool(a.children[ca[i]]))
            todo += [(ca[i], m) for m in cb[descend]]
            few = open_[i] & ~descend  # few rows, or leaves of (nearly) identical vectors: every pair is decided
            if few.any():
                mb = below[few[owner]]
                for lo in range(0, len(mb), _WIDE):
                    part = mb[lo : lo + _WIDE]
                    some(ma, part, a.x[ma] @ b.x[part].T >= cosine)
    return links_a, links_b, groups


def least_reachable(groups: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The least name of each row's group."""
    _, place = np.unique(groups, return_inverse=True)
    least = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(least, place, names)
    return least[place]
