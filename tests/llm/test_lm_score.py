import numpy as np

from loomgraph.llm import lm_score
from loomgraph.llm.lm_score import BUCKETS, CLASSES, TYPES, WINDOW, WindowNetwork, score_documents, windows


def test_scores_equal_explicit_softmax(spark):
    texts = ["a b c d e f", "", None, "  ", "x", "a b c " * 200, "the cat sat on the mat"] * 3
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)] + [(None, "a b", "x", 2)], "doc_id long, text string, key string, words int")
    scores, net = score_documents(docs, share=1)
    got = {r["doc_id"]: r for r in scores.collect()}
    assert len(got) == len(texts) + 1
    assert got[1]["n_words"] == got[2]["n_words"] == got[3]["n_words"] == 0 and got[1]["mean_log_likelihood"] is None
    assert abs(got[0]["log_likelihood"] - got[7]["log_likelihood"]) < 1e-3
    assert got[5]["mean_log_likelihood"] > got[0]["mean_log_likelihood"]
    # one document again, position by position with whole distributions
    ids = np.array([3, 40, TYPES - 9, 3])
    near, _ = windows(ids, np.array([0, 4]))
    for i, word in enumerate(ids):
        beside = [ids[i + j] if 0 <= i + j < 4 else net.pad for j in range(-WINDOW, WINDOW + 1) if j]
        assert list(near[i]) == beside
        h = np.tanh(net.b + sum(net.S[j] * net.E[w] for j, w in enumerate(beside)))
        p = 0.0
        every = []
        for c in range(CLASSES):
            pc = np.exp(h @ net.Wc + net.bc)
            pi = np.exp(h @ net.Wi[c] + net.bi[c])
            every += list(pc[c] / pc.sum() * pi / pi.sum())
        p = np.log(every[word])
        assert abs(sum(every) - 1) < 1e-4
        assert abs(net.log_probabilities(ids, near)[i] - p) < 1e-4


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    net = WindowNetwork.started(np.ones(CLASSES * CLASSES))
    net = WindowNetwork(net.vector.astype(np.float64))
    words, near = rng.integers(0, TYPES, 20), rng.integers(0, TYPES + 1, (20, 2 * WINDOW))
    near[3:7] = near[3]
    g = net.gradient(words, near)
    for i in [*np.argsort(-np.abs(g))[:5], *rng.integers(0, len(g), 5)]:
        e = 1e-5
        up, down = net.vector.copy(), net.vector.copy()
        up[i] += e
        down[i] -= e
        slope = -(WindowNetwork(up).log_probabilities(words, near).mean() - WindowNetwork(down).log_probabilities(words, near).mean()) / (2 * e)
        assert abs(slope - g[i]) < 1e-6


def test_training_beats_frequencies(spark):
    texts = ["one two three four five six " * 30, "six five four three two one " * 30] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    before = score_documents(docs, rounds=0)[0].agg({"log_likelihood": "sum"}).first()[0]
    after = score_documents(docs, share=2)[0].agg({"log_likelihood": "sum"}).first()[0]
    assert after > 0.7 * before


def test_empty_table(spark):
    assert score_documents(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """Several shards, few and many partitions: the same positions train the same networks."""
    monkeypatch.setattr(lm_score, "SHARD", 500)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.5, 60) % 500) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    few, many = ({r["doc_id"]: r["log_likelihood"] for r in score_documents(docs.repartition(n), share=4)[0].collect()} for n in (4, 32))
    assert all(abs(few[k] - many[k]) < 1e-3 * abs(few[k]) for k in few)


def test_long_texts_are_scored_whole(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "_POSITIONS", 64)
    text = " ".join(f"w{k % 7}" for k in range(1000))
    whole = score_documents(spark.createDataFrame([(1, text), (2, "w1 w2")], "doc_id long, text string"), rounds=0)[0].collect()
    assert {r["doc_id"]: r["n_words"] for r in whole} == {1: 1000, 2: 2}
    assert all(r["log_likelihood"] < r["n_words"] * -1.0 for r in whole)


def test_rare_words_of_repeated_documents_are_known(spark):
    """Of two documents of rare words, the one that occurs twice is likelier: its words stand in another document."""
    common = [" ".join(f"c{i}" for i in range(TYPES - BUCKETS))] * 3
    twice, once = (" ".join(f"{name}{i}" for i in range(200)) for name in ("a", "b"))
    docs = spark.createDataFrame(list(enumerate([*common, twice, twice, once])), "doc_id long, text string")
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in score_documents(docs, rounds=0)[0].collect()}
    assert abs(got[3] - got[4]) < 1e-6 and got[3] > got[5] + 3


def test_buckets_hold_all_rarer_words(spark):
    from collections import Counter

    from loomgraph.llm.lm_score import _bucket_sizes, _buckets, _word_counts

    texts = [" ".join(f"c{i}" for i in range(960))] * 60 + [" ".join(f"w{i}" for i in range(3000))]
    counts = _word_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    rows, expected = counts.collect(), Counter()
    known = np.array([r["word"] for r in rows if r["n"] >= 60], np.int64).view(np.uint64)
    sizes, different = _bucket_sizes(counts, known)
    for r in rows:
        if r["n"] < 60:
            expected[int(_buckets(np.array([r["word"]]).view(np.uint64))[0]) - (TYPES - BUCKETS)] += r["n"]
    assert list(sizes) == [expected[b] for b in range(BUCKETS)]
    assert different.sum() == sum(r["n"] < 60 for r in rows)


def test_many_shards_are_averaged_in_bounded_groups(spark, monkeypatch):
    """Five levels of at most four; the mean is that over all shards."""
    monkeypatch.setattr(lm_score, "FAN", 4)
    rng = np.random.default_rng(4)
    shards, sizes = 600, []
    weights, changes = rng.integers(1, 50, shards), rng.normal(0, 0.1, (shards, 2, 8)).astype(np.float16)
    rows = [(p, s, int(weights[s]), changes[s, p].tobytes()) for s in range(shards) for p in range(2) if s != 77]
    frame = spark.createDataFrame(rows, lm_score._CHANGES).repartition(7)
    got = {r["part"]: (r["n"], np.frombuffer(r["v"], np.float32)) for r in lm_score._averaged(frame, shards).collect()}
    keep = np.arange(shards) != 77
    for p in range(2):
        assert got[p][0] == weights[keep].sum()
        np.testing.assert_allclose(got[p][1], np.average(changes[keep, p].astype(float), axis=0, weights=weights[keep]), atol=1e-5)
    plan = lm_score._averaged(frame, shards)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 5
