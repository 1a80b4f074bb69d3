import hashlib
import random
import zlib

import numpy as np
import pytest

from loomgraph.llm.prefix_trie import LeastOf, op11_prefix_trie, prefix_trie, rebuilt

SCHEMA = "conv_id long, turn long, role string, text string, depth long, key string"


def brute(rows):
    turns = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in turns.items()}
    made = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - c % 100, [])[:h] + mine[h:]
    members = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = set()

    def below(p):
        kids = [below(k) for k in children.get(p, [])]
        leaves = sum(k[0] for k in kids) if kids else 1
        saved = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(k[1] for k in kids)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(made[c]) == len(p))))
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        below(())
    return out


def made_rows(seed, convs=160):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(500), convs):
        if c % 100 == 0 and rng.random() < 0.3:
            continue
        for t in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((c, None if t == 0 and rng.random() < 0.2 else t, rng.choice(["user", "user", None]), rng.choice(["", None, "a", "ää", "long text"]) if t else "hi", 1, "k"))
    rows += [(c, t, "user", f"copy {t}", 1, "k") for c in range(600, 640) for t in range(7)]
    rows += [(None, 1, "user", "no conversation", 1, "k"), (7000, 3, "user", "late", 1, "k"), (7001, 0, None, None, 1, "k")]
    rows += [(8000, t, "user", "deep", 1, "k") for t in range(300)] + [(8001, t, "user", "deep", 1, "k") for t in range(290)]
    return rows


@pytest.mark.parametrize("block", [1, 3, 16, 4096])
def test_equals_brute_force(spark, block):
    rows = made_rows(block)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in prefix_trie(rebuilt(frame), block).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_empty_table_and_single_conversation(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(rebuilt(empty)).count() == 0
    one = [(5, 0, "user", "x", 0, ""), (5, 0, "user", "x", 0, "")]
    got = {tuple(r) for r in prefix_trie(rebuilt(spark.createDataFrame(one, SCHEMA))).collect()}
    assert got == brute(one)


def test_sparse_table_against_loops():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 37):
        v = rng.integers(0, 4, n)
        t = LeastOf(v)
        for i in range(n):
            for bound in range(5):
                r = i
                while r + 1 < n and v[r + 1] >= bound:
                    r += 1
                left = i
                while left > 0 and v[left] >= bound:
                    left -= 1
                assert t.right(np.array([i]), np.array([bound]))[0] == r
                assert t.left(np.array([i]), np.array([bound]))[0] == left
            for j in range(i, n):
                assert t.least(np.array([i]), np.array([j]))[0] == v[i : j + 1].min()


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in op11_prefix_trie(spark, d).collect()} == brute(rows)
