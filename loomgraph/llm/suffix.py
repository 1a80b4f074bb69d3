"""Enhanced suffix arrays over fragments of text: suffix ranks, common prefixes, maximal repeats."""

from __future__ import annotations

import numpy as np


def prefix_ranks(data: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(d, rank of each position by its next d bytes) for d = 8, 16, ... up to at least depth.

    Prefix doubling; positions past the end count as smallest.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[j : j + n]
    levels, d = [], 8
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.uint32)
        rank[order] = np.cumsum(np.concatenate(([1], sorted_key[1:] != sorted_key[:-1]))) if n else 0
        levels.append((d, rank))
        if d >= depth:
            return levels
        after = np.zeros(n, np.uint64)
        after[: max(0, n - d)] = rank[d:]
        key = rank.astype(np.uint64) << np.uint64(32) | after
        d *= 2


def common_prefix(data: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and at b, at most `most` (three times the deepest level)."""
    n, length = len(data), np.zeros(len(a), np.int64)
    for d, rank in [levels[-1], levels[-1], *reversed(levels)]:
        x, y = np.minimum(a + length, n - 1), np.minimum(b + length, n - 1)
        length += np.where((rank[x] == rank[y]) & (length < most), d, 0)
    for _ in range(7):
        x, y = np.minimum(a + length, n - 1), np.minimum(b + length, n - 1)
        length += (data[x] == data[y]) & (length < most)
    return np.minimum(length, most)


def maximal_repeats(lcp: np.ndarray, left: np.ndarray, least: int) -> np.ndarray:
    """(length, first, last) of the left-diverse common-prefix intervals of at least `least` bytes.

    lcp[i] is the common prefix of the i-th and the previous suffix in order, left[i] the byte
    before the i-th suffix, or -1 where it is unknown. One stack scan; an interval is maximal to
    the left if the bytes before its suffixes differ.
    """
    found = []
    inner = np.flatnonzero(np.asarray(lcp) >= least)
    if not len(inner):
        return np.zeros((0, 3), np.int64)
    breaks = np.flatnonzero(np.diff(inner) > 1)
    lows, highs = inner[np.concatenate(([0], breaks + 1))], inner[np.concatenate((breaks, [len(inner) - 1]))]
    for low, high in zip(lows.tolist(), highs.tolist()):
        stack: list[list[int]] = []
        lengths, bytes_before = lcp[low : high + 1].tolist() + [0], left[low - 1 : high + 1].tolist()
        for i, (length, before) in enumerate(zip(lengths, bytes_before), low - 1):
            first = i
            while stack and stack[-1][0] > length:
                closed, first, common = stack.pop()
                if common != before:
                    before = -1
                if before == -1:
                    found.append((closed, first, i))
            if length:
                if stack and stack[-1][0] == length:
                    if stack[-1][2] != before:
                        stack[-1][2] = -1
                else:
                    stack.append([length, first, before])
    return np.array(found, dtype=np.int64).reshape(-1, 3)


def _order(level: tuple[int, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Order of the suffixes at `at` by three times the level's bytes; only they are sorted that deep."""
    d, rank = level
    padded = np.concatenate((rank, np.zeros(2 * d, np.uint32))).astype(np.uint64)
    key = padded[at] << np.uint64(32) | padded[at + d]
    order = np.argsort(key)
    deeper = np.empty(len(at), np.uint64)
    deeper[order] = np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1]))) if len(at) else 0
    return np.argsort(deeper << np.uint64(32) | padded[at + 2 * d])


def repeats_in(texts: list[bytes], starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats among the first starts[i] suffixes of each text (UTF-8, in which no byte is 255).

    A byte 255 ends each text, so that suffixes are ordered by their own text alone: by what follows it in the
    array, a text that ends early could stand between two that agree for longer, and hide their repeat.
    Returns data, base (offset of each text), suffixes in order, their texts and (length, first, last) rows.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    base = np.concatenate(([0], np.cumsum(sizes + 1)))
    data = np.frombuffer(b"".join(t + b"\xff" for t in texts), dtype=np.uint8)
    levels = prefix_ranks(data, -(-int(sizes.max() + 1) // 3))
    of = np.repeat(np.arange(len(texts)), starts)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts, starts)
    at = base[of] + inside
    order = _order(levels[-1], at)
    at, of, inside = at[order], of[order], inside[order]
    room = base[of + 1] - 1 - at
    lcp = np.zeros(len(at), np.int64)
    lcp[1:] = common_prefix(data, levels, at[:-1], at[1:], np.minimum(room[:-1], room[1:]))
    left = np.where(inside > 0, data[at - 1].astype(np.int64), -1)
    return data, base, at, of, maximal_repeats(lcp, left, least)
