"""Word shingles of whole texts as 64-bit hashes, computed over Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
#: Bytes of text hashed in one go; a longer text is hashed alone.
STRIDE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTER = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_parts(column: pa.Array, stride: int = STRIDE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, byte offsets) of runs of rows with about stride bytes; null is empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.null_count:
        column = column.fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + stride, side="right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lowered, parted by white space) and the row of each."""
    return sized_words(data, offsets)[:2]


def sized_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, the row of each, and its bytes."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    breaks = np.zeros(n + 1, dtype=bool)
    breaks[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | breaks[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | breaks[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_LETTER[_LOWER[data]] * powers(_BASE, n), out=total[1:])
    hashes = (total[ends] - total[starts]) * powers(_UNBASE, n)[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(offsets, starts, side="right") - 1, ends - starts


def shingle_sets(column: pa.Array, words: int = SHINGLE_WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, offsets): each row's distinct shingle hashes in ascending order.

    With fewer words than a shingle has, the whole sequence is the one shingle; without words
    the set is empty.
    """
    factors = powers(np.uint64(0xD6E8FEB86659FD93), words)
    for first, data, offsets in text_parts(column):
        rows = len(offsets) - 1
        hashes, of = word_hashes(data, offsets)
        counts = np.bincount(of, minlength=rows)
        begins = np.concatenate(([0], np.cumsum(counts)))
        long = np.zeros(max(0, len(hashes) - words + 1), dtype=np.uint64)
        for j in range(words):
            long += hashes[j : j + len(long)] * factors[j]
        long = mix(long)
        sets = []
        for i in range(rows):
            a, b = begins[i], begins[i + 1]
            if b - a >= words:
                own = np.sort(long[a : b - words + 1])
                sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
            elif b > a:
                sets.append(mix(np.array([(hashes[a:b] * factors[: b - a]).sum() + np.uint64(b - a)])))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield first, np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))
