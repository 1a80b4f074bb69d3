import numpy as np
import pytest

from loomgraph.llm import cover_tree
from loomgraph.llm.cover_tree import CoverTree, dual_links
from loomgraph.llm.embedding_dedup import near_embeddings


def brute(rows, cosine):
    """rows: (id, vector, label): {position: (links, component)}"""
    units = []
    for i, v, label in rows:
        ok = i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) / max(map(abs, v)) if ok else None
        units.append(x / np.linalg.norm(x) if ok else None)
    n = len(rows)
    linked = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine] for i in range(n)]
    label = [r[0] for r in rows]
    for _ in range(n):
        for i in range(n):
            for j in linked[i]:
                label[i] = label[j] = min(label[i], label[j])
    return [(rows[i][0], len(linked[i]), label[i]) for i in range(n)]


def made(seed, n=150, dims=6):
    rng = np.random.default_rng(seed)
    rows, centers = [], rng.normal(size=(6, dims))
    for k in range(n):
        v = centers[k % 6] + rng.normal(size=dims) * (0.02 + 0.25 * (k % 5 == 0)) if k % 3 else rng.normal(size=dims)
        rows.append((k * 7 % 1009, [float(x) for x in v], k % 2))
    return rows


@pytest.mark.parametrize("block", [2048, 16])
def test_equals_brute_force(spark, block):
    odd = [(5000, None, 0), (5001, [], 0), (5002, [0.0] * 6, 0), (5003, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (5004, [float("nan")] * 6, 1), (5005, [float("inf")] + [1.0] * 5, 1)]
    odd += [(5006, [1.0, 2.0, 3.0], 0), (5007, [2.0, 4.0, 6.0], 0), (5008, [1.0] * 6, None), (None, [1.0] * 6, 1), (5009, [1e300] * 6, 0), (5010, [1e-300] * 6, 0)]
    rows = made(1) + odd
    rows += [(6000 + k, rows[k][1], rows[k][2]) for k in range(0, 30, 3)]  # identical vectors
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, label int, id string, w int").repartition(4)
    got = near_embeddings(frame, block=block, pivots=64).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in got], key=key) == sorted(brute(rows, 0.98), key=key)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_empty_table(spark):
    assert near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("direct", [1, 1 << 14])
def test_dual_traversal(monkeypatch, direct):
    monkeypatch.setattr(cover_tree, "_DIRECT", direct)
    x = np.array([v for _, v, _ in made(2, 200)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = np.concatenate((x, x[:5]))
    w = np.arange(1.0, len(x) + 1)
    tree = CoverTree(x)
    truth = x @ x.T >= 0.98
    links, _, groups = dual_links(tree, tree, 0.98, w, w)
    assert np.allclose(links, truth @ w)
    reach = truth.copy()
    for _ in range(8):
        reach = reach @ reach > 0
    assert ((groups[:, None] == groups[None, :]) == reach).all()
    left, right, _ = dual_links(CoverTree(x[:80]), CoverTree(x[80:]), 0.98, w[:80], w[80:])
    assert np.allclose(left, truth[:80, 80:] @ w[80:]) and np.allclose(right, w[:80] @ truth[:80, 80:])


def test_tree_invariants():
    x = np.array([v for _, v, _ in made(3, 120)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = CoverTree(x)
    for node, members in enumerate(tree.members):
        far = np.sqrt(np.maximum(2 - 2 * x[members] @ x[tree.center[node]], 0))
        assert far.max() <= tree.radius[node] + 1e-7
        children = tree.children[node]
        if children:
            assert tree.center[children[0]] == tree.center[node]  # nested
            assert sorted(np.concatenate([tree.members[c] for c in children])) == sorted(members)
            assert all(tree.radius[c] <= tree.radius[node] / 2 + 1e-9 for c in children)
            at = x[[tree.center[c] for c in children]]
            apart = np.sqrt(np.maximum(2 - 2 * at @ at.T, 0)) + 9 * np.eye(len(children))
            assert apart.min() > tree.radius[node] / 2


def test_block_pairs_are_groups_of_the_shuffle(spark):
    """With broadcasts off, the plan still deals a crowded cell by its pairs of blocks, not by the cell."""
    from loomgraph.llm import embedding_dedup

    plans, written = [], embedding_dedup.written
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(embedding_dedup, "written", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), written(df, name))[1])
            frame = spark.createDataFrame(made(4, 120), "vec_id long, embedding array<double>, label int")
            assert near_embeddings(frame, block=16, pivots=8).count() == 120
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    traversal = next(p for p in plans if "FlatMapGroupsInArrow" in p)
    after = traversal[traversal.index("FlatMapGroupsInArrow") :]
    first = after[after.index("Exchange") :].split("\n")[0]
    assert all(f"{c}#" in first for c in ("label", "cell", "a", "b"))


def test_other_ids_are_refused(spark):
    with pytest.raises(ValueError):
        near_embeddings(spark.createDataFrame([("x", [1.0], 1)], "vec_id string, embedding array<double>, label int"))
