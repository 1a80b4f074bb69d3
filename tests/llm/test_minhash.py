import random

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import shingles
from loomgraph.llm.minhash import near_dedup
from tests.llm.test_pipeline import shingles as plain_shingles


def brute(rows):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets.setdefault(i, []).append(plain_shingles(t))
    ids, least = sorted(sets), {i: i for i in sets}
    near = lambda a, b: a and b and 100 * len(a & b) >= 75 * len(a | b)
    links = [(a, b) for a in ids for b in ids if a < b and any(near(x, y) for x in sets[a] for y in sets[b])]
    for _ in ids:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return [(i, len(plain_shingles(t)), least.get(i), i == least.get(i)) for i, t, *_ in rows]


def drifting(seed, n):
    """Copies of copies: neighbours are similar, the first and the last are not."""
    rng, words = random.Random(seed), [f"w{k}" for k in range(300)]
    text, out = [rng.choice(words) for _ in range(120)], []
    for _ in range(n):
        text = list(text)
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    base = " ".join(f"c{k}" for k in range(140))
    hub = [" ".join(w if rng.random() > 0.04 else f"e{rng.random()}" for w in base.split()) for _ in range(60)]
    texts = drifting(seed, 40) + hub + [base, base.upper(), "a b", "A  b", "a b c", "", None, " \n ", "é x", "É x"]
    texts += [" ".join(rng.choice("the of and to in".split()) for _ in range(rng.randint(4, 12))) for _ in range(30)]
    rows = [(k * 5 % 991, t, "clash", 1) for k, t in enumerate(texts)] + [(None, base, "c", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, component string, rep int").repartition(5)
    got = near_dedup(frame).collect()
    found = sorted([(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None])
    assert found == sorted(x for x in brute(rows) if x[0] is not None)
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]


def test_repeated_rows_and_empty_table(spark):
    rows = [(3, "a b c d e f g"), (3, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (2, None)]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(1, 1, True), (2, 2, True), (2, 2, True), (3, 1, False), (3, 1, False)]
    assert near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sets_do_not_depend_on_batches():
    rng = random.Random(4)
    texts = [None, "", "one", "x " * 50] + [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(0, 40))) for _ in range(100)]
    whole = {}
    for stride in (1, 64, 1 << 20):
        found = []
        column = pa.array(texts)
        for _, hashes, offsets in (x for x in _parts(column, stride)):
            found += [tuple(hashes[a:b]) for a, b in zip(offsets, offsets[1:])]
        whole[stride] = found
        assert [len(f) for f in found] == [len(plain_shingles(t)) for t in texts]
    assert whole[1] == whole[64] == whole[1 << 20]


def _parts(column, stride):
    old = shingles.text_parts
    shingles.text_parts = lambda c: old(c, stride)
    try:
        yield from shingles.shingle_sets(column)
    finally:
        shingles.text_parts = old
