"""Golden values and properties of single operators."""

import json
import random
import re
import struct
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from loomgraph.functions import codec
from loomgraph.functions import exprs as X
from loomgraph.operators import access, block_layout, corpus, documents, far_field, folds, graph, layout, pieces, ranking, search, settings
from loomgraph.operators import corpus as C
from loomgraph.operators import mentions as M
from loomgraph.operators.paging import PageIndex
from loomgraph.operators.search_index import SearchIndex
from loomgraph.sources import tables


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["_"])
    return frame.select(column.alias("v")).first()["v"]


def test_mass_and_size(spark):
    assert one(spark, X.mass(F.col("s")), s=100) == 12
    assert one(spark, X.mass(F.col("s")), s=1_000_000) == 38
    assert one(spark, X.node_size(F.col("s")), s=1000) == 14.0
    assert one(spark, X.node_size(F.col("s")), s=10**9) == 50.0


def test_names(spark):
    assert one(spark, X.stem(F.col("n")), n="a.md.md") == "a"
    assert one(spark, X.stem_once(F.col("n")), n="a.md.md") == "a.md"
    assert one(spark, X.is_public(F.col("c")), c="\n \tpublic:: true\nrest") is True
    assert one(spark, X.link_count(F.col("c")), c="[a](b) [c] (d) [e](f)") == 2
    assert one(spark, X.camel(F.col("c")), c="max_update_rate") == "maxUpdateRate"
    assert one(spark, X.snake(F.col("c")), c="maxUpdate-rate") == "max_update_rate"
    assert one(spark, X.spaced_title(F.col("c")), c="enableXr") == "Enable XR"
    assert [one(spark, X.parsed_id(F.col("c")), c=c) for c in ("7", "x", "4294967296", "-1")] == [7, 0, 0, 0]
    assert one(spark, X.client_id(F.col("c"), F.lit(4)), c="12abc") == 12
    assert one(spark, X.path_prefixes(F.col("c")), c="a.b") == ["", "a", "a.b"]
    assert one(spark, X.csv_list(F.col("c")), c=" a, ,b,") == ["a", "b"]


def test_rounding_scales_first(spark):
    assert one(spark, X.rounded(F.col("v"), 6), v=0.7965274999999999) == 0.796528
    assert [one(spark, X.rounded(F.col("v"), 2), v=v) for v in (-1.125, 1.124, 0.0)] == [-1.13, 1.12, 0.0]


def test_gesture_confidence_keeps_its_extension(spark):
    from loomgraph import plans

    row = plans.QUERIES["gesture_confidence"](spark, "/root/testdata/sf0.001")
    assert row.columns == ["event_id", "confidence", "extension"]
    assert [one(spark, X.extension(F.col("f"), F.lit(0.25)), f=f) for f in (0.0, 0.75, 2.0)] == [0.0, 0.5, 1.0]


def test_wav_header(spark):
    raw = b"RIFF" + struct.pack("<I", 36) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 44100, 88200, 2, 16) + b"data" + struct.pack("<I", 0)
    assert tuple(one(spark, X.wav_header(F.col("r")), r=bytearray(raw))) == (1, 44100, 16)
    assert one(spark, X.wav_header(F.col("r")), r=bytearray(44)) is None


def test_frames(spark):
    rows = [(1, 1.0, 2.0, 3.0, 0.1, 0.2, 0.3), (2, 4.0, 5.0, 6.0, 0.4, 0.5, 0.6)]
    packed = codec.frames(spark.createDataFrame(rows, "id long, x double, y double, z double, vx double, vy double, vz double"))
    payload = bytes(packed.first()["payload"])
    assert len(payload) == 56 and payload == b"".join(struct.pack("<I6f", *r) for r in rows)
    back = codec.decode_frames(packed).collect()
    assert [(r["id"], r["mass"], r["flags"]) for r in back] == [(1, 100, 0), (2, 100, 0)]
    odd = spark.createDataFrame([(1, bytearray(27))], "frame_id long, payload binary")
    with pytest.raises(PythonException):
        codec.decode_frames(odd).collect()
    assert codec.decode_frames(odd, strict=False).count() == 0
    assert codec.decode_frames(spark.createDataFrame([(1, bytearray())], "frame_id long, payload binary")).count() == 0
    nan = bytearray(struct.pack("<I6f", 1, float("nan"), 0, 0, 0, 0, 0) + struct.pack("<I6f", 2, 1, 0, 0, 0, 0, 0) + b"x")
    assert [r["id"] for r in codec.decode_frames(spark.createDataFrame([(1, nan)], "frame_id long, payload binary"), strict=False).collect()] == [2]


def test_inflate(spark):
    data = b"position " * 50
    assert bytes(one(spark, codec.inflate(F.col("r")), r=bytearray(zlib.compress(data)))) == data
    assert bytes(one(spark, codec.inflate(F.col("r")), r=bytearray(b"raw"))) == b"raw"


def test_access_matrix(spark):
    users = spark.createDataFrame([("pub1", ["perplexity", "openai", "settings_sync", "power"]), ("pub2", ["perplexity", "settings_sync"]), ("none", []), ("boss", ["power"])], "pubkey string, roles array<string>")
    found = {r["pubkey"]: r["features"] for r in access.with_features(users).collect()}
    assert found == {"pub1": ["perplexity", "openai", "settings_sync", "power_user"], "pub2": ["perplexity", "settings_sync"], "none": [], "boss": ["settings_sync", "power_user"]}
    assert not any(r["allowed"] for r in access.has_feature(users, "power_user").collect())


def test_numbered(spark):
    rows = [(random.Random(k).random(), k) for k in range(500)]
    frame = ranking.numbered(spark.createDataFrame(rows, "a double, b long").repartition(7), "a", "b")
    assert [r["b"] for r in sorted(frame.collect(), key=lambda r: r["row"])] == [b for _, b in sorted(rows)]
    assert sorted(r["row"] for r in frame.collect()) == list(range(500))


def test_new_ids(spark):
    rows = [("a", "7"), ("b", "0"), ("c", "junk"), ("d", "3")]
    found = corpus.with_new_ids(spark.createDataFrame(rows, "metadata_id string, node_id string"))
    assert {r["metadata_id"]: r["id"] for r in found.collect()} == {"a": 7, "d": 3, "b": 8, "c": 9}


def mentioned(spark, content, *names):
    files = spark.createDataFrame([(1, content), (2, None)], "k long, content string")
    vocabulary = corpus.vocabulary(spark.createDataFrame([(n,) for n in names], "n string"), "n")
    return {r["name"]: r["n"] for r in corpus.mentions(files, vocabulary, "k").collect()}


def test_mentions_of_words_and_phrases(spark):
    assert mentioned(spark, "Naïve na NAÏVE, old road. old-road", "naïve", "Old Road", "absent") == {"naïve": 2, "Old Road": 1}
    assert mentioned(spark, "foo-bar, foo bar; xfoo-bar", "foo-bar", "foo bar") == {"foo-bar": 1, "foo bar": 1}
    assert mentioned(spark, "na na na na", "na na", "na") == {"na na": 2, "na": 4}  # without overlap
    assert mentioned(spark, "c++x and c++ and c", "c++", "c") == {"c++": 1, "c": 3}  # a border follows only where a word does
    assert mentioned(spark, "a++b ++ c", "++", "One Two") == {"++": 1}
    assert mentioned(spark, "one two three four five six", "One Two Three four", "TWO") == {"One Two Three four": 1, "TWO": 1}
    assert mentioned(spark, "e\u0301t e\u0301 e", "e") == {"e": 1}  # combining marks belong to words
    assert mentioned(spark, r"a\Eb a\Eb", r"a\Eb") == {r"a\Eb": 2}


def test_page_errors(spark):
    nodes = spark.range(5).toDF("id")
    for number, size in ((0, 2), (4, 2), (1, 0)):
        with pytest.raises(ValueError):
            graph.page(nodes, number, size)
    assert [r["id"] for r in graph.page(nodes, 3, 2)[0].collect()] == [4]
    assert graph.page(nodes.limit(0), 1, 2)[1]["total_pages"] == 0


def made_nodes(spark, n=80, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(k, *map(float, rng.normal(0, 1.5, 3)), *map(float, rng.normal(0, 0.1, 3)), int(rng.integers(0, 256))) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double, z double, vx double, vy double, vz double, mass int")


def test_edge_step_equals_loops(spark):
    rows, nodes = made_nodes(spark)
    links = [(k, (k * 7 + 1) % 80, 1.0 + k % 3) for k in range(40)]
    p = layout.Params()
    force = np.zeros((80, 3))
    at, m = np.array([r[1:4] for r in rows]), np.array([r[7] for r in rows]) / 255 * 10
    for i in range(80):
        for j in range(80):
            d = at[j] - at[i]
            s = d @ d
            if i != j and s >= 1e-4 and s**0.5 <= p.reach:
                force[i] -= d / s**0.5 * p.repulsion * m[i] * m[j] / s
    assert abs(force.sum(axis=0)).max() < 1e-9  # equal and opposite
    for s, t, w in links:
        pull = (at[t] - at[s]) * p.spring * w
        force[s] += pull
        force[t] -= pull
    v = np.array([r[4:7] for r in rows]) * p.damping + force * p.time_step
    got = layout.edge_step(nodes, spark.createDataFrame(links, "source long, target long, weight double"), p, tile=16)
    got = np.array([[r[c] for c in ("x", "y", "z", "vx", "vy", "vz")] for r in sorted(got.collect(), key=lambda r: r["id"])])
    assert np.allclose(got[:, :3], at + v * p.time_step) and np.allclose(got[:, 3:], v)


def test_neighbours_equal_brute_force(spark):
    rows, nodes = made_nodes(spark)
    at = np.array([r[1:4] for r in rows])
    near = ((at[:, None] - at[None]) ** 2).sum(axis=2) <= 0.8**2
    got = {r["id"]: r["n"] for r in layout.neighbour_counts(nodes, 0.8, tile=8).collect()}
    assert got == {k: int(near[k].sum()) - 1 for k in range(80)}


def test_edges_are_dealt_by_their_number(spark):
    counts = spark.createDataFrame([(1, 2, 3), (2, 1, 4), (5, 5, 9), (3, 1, 1)], "source long, target long, weight long")
    plain, dealt = graph.undirected_edges(counts), graph.undirected_edges(counts, rows=100 * tables.TASK_ROWS)
    assert dealt.rdd.getNumPartitions() == 100
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect())) == [("1-2", 1, 2, 7), ("1-3", 1, 3, 1)]


def test_documents_are_dealt_to_many_tasks(spark):
    from loomgraph import plans

    frame = plans.QUERIES["nested_case"](spark, "/root/testdata/sf0.1")  # 20,000 rows in one small file
    assert frame.rdd.getNumPartitions() == 2


def test_mentions_keep_their_batches_small(spark):
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    files = spark.createDataFrame([(1, "a b")], "doc_id long, content string")
    assert C.mentions(files, C.vocabulary(spark.createDataFrame([("b",)], "n string"), "n"), "doc_id").count() == 1
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "2000"
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_dense_forces_equal_loops():
    rng = np.random.default_rng(5)
    one, two = (np.concatenate([rng.normal(size=(3, n)) + 50.0, rng.random((1, n))]) for n in (37, 90))
    kernel = layout.push(layout.Params())
    forces, back = layout.dense_forces(kernel, one, two, both=True)
    want, other = np.zeros((3, 37)), np.zeros((3, 90))
    for i in range(37):
        for j in range(90):
            d = two[:3, j] - one[:3, i]
            square = np.array([d @ d])
            f = kernel(square, np.sqrt(square))[0] * one[3, i] * two[3, j] * d
            want[:, i] += f
            other[:, j] -= f
    np.testing.assert_allclose(forces, want, atol=1e-9)
    np.testing.assert_allclose(back, other, atol=1e-9)


def _clouds():
    """Places of nodes: scattered, wide, on a lattice (distances of exactly 2 and 3), copies of few places, far from the origin, and with one far outlier."""
    rng = np.random.default_rng(11)
    scattered = rng.normal(size=(3, 1500))
    lattice = np.stack(np.meshgrid(*[np.arange(11.0)] * 3)).reshape(3, -1) / 2.0
    yield from (scattered, scattered * 40.0, lattice, np.repeat(scattered[:, :40], 30, axis=1), scattered + 1e4)
    yield np.concatenate([scattered, [[1e7], [0.0], [0.0]]], axis=1)


@pytest.mark.parametrize("params, iteration", [(layout.Params(), 3), (layout.Params(), 120), (layout.Params(reach=0.5), 40), (layout.Params(reach=4.0), 40), (layout.Params(repulsion=-0.1), 40)])
def test_pieces_give_the_forces_of_all_pairs(params, iteration):
    kernel, forms = layout.all_pairs_act(params, iteration)[1], layout.all_pairs_pieces(params, iteration)
    plain = lambda one, two, both: layout.dense_forces(kernel, one, two, both)
    for place in _clouds():
        nodes = np.concatenate([place, np.random.default_rng(1).uniform(0.1, 1.0, (1, place.shape[1]))])
        one, two = nodes[:, ::2], nodes[:, 1::2]
        for got, want in zip(pieces.forces_by_pieces(forms, plain, one, two, True), plain(one, two, True)):
            np.testing.assert_allclose(got, want, rtol=0, atol=1e-11 * np.abs(want).max())
        got, back = pieces.forces_by_pieces(forms, plain, nodes, nodes)
        want = plain(nodes, nodes, False)[0]
        np.testing.assert_allclose(got, want, rtol=0, atol=1e-11 * np.abs(want).max())
        assert back is None


def test_few_pairs_of_all_are_left_to_the_whole_formula():
    rng = np.random.default_rng(2)
    nodes = np.concatenate([rng.normal(size=(3, 6000)), np.ones((1, 6000))])
    forms, left = layout.all_pairs_pieces(layout.Params(), 120), []

    def rest(one, two, both):
        left.append(one.shape[1] * two.shape[1])
        return np.zeros((3, one.shape[1])), None

    pieces.forces_by_pieces(forms, rest, nodes, nodes)
    assert 0 < sum(left) < 0.2 * 6000**2
    order, begins = pieces.blocks(nodes[:3])
    assert sorted(order) == list(range(6000)) and np.diff(begins).max() <= pieces.BLOCK


def test_tiles_of_all_pairs_lie_together_and_change_nothing(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), *map(float, p), 0.5) for i, p in enumerate(rng.normal(size=(1500, 3)))] + [(1500, float("nan"), 0.0, 0.0, 0.5), (1501, None, 0.0, 0.0, 0.5)]
    nodes = spark.createDataFrame(rows, "id long, x double, y double, z double, m double").cache()
    forces = lambda tile: {r["id"]: [r["fx"], r["fy"], r["fz"]] for r in layout.all_pairs_forces(nodes, layout.Params(), 120, tile).collect()}
    want, got = forces(4096), forces(600)
    assert set(want) == set(got) == set(range(1502))
    for i in range(1500):
        np.testing.assert_allclose(got[i], want[i], atol=1e-10)
    ordered = np.array([[r["x"], r["y"], r["z"]] for r in nodes.filter("x < 9").orderBy(layout._curve(nodes)).select("x", "y", "z").collect()])
    by_id = np.array([r[1:4] for r in rows[:1500]])
    spread = lambda places: np.mean([np.ptp(places[i : i + 125], axis=0).prod() for i in range(0, 1500, 125)])
    assert spread(ordered) < 0.5 * spread(by_id)


def test_a_node_without_a_place_does_not_spoil_the_others(spark):
    rows = [(i, float(i % 7), float(i % 5), float(i % 3), 0.5) for i in range(200)]
    schema = "id long, x double, y double, z double, m double"
    forces = lambda rows, tile: {r["id"]: [r["fx"], r["fy"], r["fz"]] for r in layout.all_pairs_forces(spark.createDataFrame(rows, schema), layout.Params(), 40, tile).collect()}
    want = forces(rows, 1024)
    for tile in (8, 1024):
        got = forces([*rows, (200, float("nan"), 0.0, 0.0, 0.5)], tile)
        for i, f in want.items():
            np.testing.assert_allclose(got[i], f, atol=1e-9)


def test_rows_of_a_crowded_cell_are_not_shuffled_by_cell(spark):
    _, nodes = made_nodes(spark)
    slim = nodes.select("id", "x", "y", "z", F.lit(1.0).alias("m"), F.floor(F.col("x") / 1e6).alias("cell"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        dealt = layout._dealt(slim, slim, ["cell"], ["id", "x", "y", "z", "m"], 8)
        assert "SortMergeJoin [cell" not in dealt._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
        assert dealt.groupBy("a", "b").count().count() > 1
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_tiles_do_not_change_all_pairs(spark):
    _, nodes = made_nodes(spark)
    order = lambda f: sorted(f.collect(), key=lambda r: r["id"])
    a, b = (order(layout.all_pairs_step(nodes, layout.Params(), 3, tile=t)) for t in (16, 4096))
    assert np.allclose([list(r) for r in a], [list(r) for r in b])


def test_empty_box_and_pins(spark):
    _, nodes = made_nodes(spark, 3)
    assert layout.bounding_box(nodes.limit(0)).first()["size"] == 50.0
    held = layout.pinned(nodes.withColumns({"pinned": F.lit(False), "tx": F.lit(0.0), "ty": F.lit(0.0), "tz": F.lit(0.0)}), 1, 1.0, 2.0, 3.0)
    row = layout.easing_tick(held, 5.0, 0.9, 0.01, 0.016).filter("id = 1").first()
    assert (row["x"], row["y"], row["z"], row["vx"]) == (1.0, 2.0, 3.0, 0.0)


def test_search_ranks(spark):
    rows = [(1, "Open", "start", ["x"], True), (2, "open file", "", [], True), (3, "reopen", "", [], True), (4, "close", "to open", [], True), (5, "quit", "", ["open"], True), (6, "open off", "", [], False)]
    commands = spark.createDataFrame(rows, "id long, title string, description string, keywords array<string>, enabled boolean")
    assert [(r["id"], r["score"]) for r in search.command_search(commands, "OPEN").collect()] == [(1, 1.0), (2, 0.8), (3, 0.6), (4, 0.4)]
    assert search.command_search(commands, "  ").count() == 5
    assert one(spark, X.fuzzy_score("opf", F.col("t")), t="open file") == pytest.approx((1 + 1.1 + 1) / 3)
    assert one(spark, X.fuzzy_score("zz", F.col("t")), t="open") == 0.0


def test_tiles_are_keys_of_the_shuffle(spark):
    """With broadcasts off a crowded cell is dealt by its tiles, and all pairs need no join by a constant."""
    _, nodes = made_nodes(spark, 60)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [layout.neighbour_counts(nodes, 0.8, tile=8), layout.all_pairs_step(nodes, layout.Params(), 3, tile=8)]
        cells, pairs = (p._jdf.queryExecution().executedPlan().toString() for p in plans)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    exchange = lambda p: p[p.index("MapInArrow") :][p[p.index("MapInArrow") :].index("Exchange") :].split("\n")[0]
    assert all(f"{c}#" in exchange(cells) for c in ("cx", "cy", "cz", "a", "b"))
    assert "a#" in exchange(pairs) and "b#" in exchange(pairs)
    assert "CartesianProduct" not in pairs and "NestedLoop" not in pairs


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_folds_equal_loops(spark, batch):
    rng = random.Random(4)
    rows = [(k % 3, k, rng.random(), rng.random() < 0.4) for k in range(300)]
    frame = spark.createDataFrame(rows, "u long, ts long, v double, on boolean").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        level = {r["ts"]: r["level"] for r in folds.smoothed(frame, "u", ["ts"], "v").collect()}
        state = {r["ts"]: r["state"] for r in folds.hysteresis(frame, "u", ["ts"], "v", "on").collect()}
        sent = {r["ts"] for r in folds.deadband(frame, "u", ["ts"], ["v"], ["v"], 0.3, 0.6).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for u in range(3):
        at, on, last = 0.0, False, None
        for k, (_, ts, v, active) in ((i, r) for i, r in enumerate(rows) if r[0] == u):
            at = 0.8 * at + (1.0 - 0.8) * v
            on = (active or v > 0.5) if on else (v > 0.8 and active)
            assert abs(level[ts] - at) < 1e-12 and state[ts] == on
            if last is None or abs(v - last) > 0.3:
                last = v
                assert ts in sent
            else:
                assert ts not in sent


def test_settings_paths_with_defaults_and_errors(spark):
    doc = '{"a":{"b_c":[{"d":1}]}}'
    assert one(spark, settings.get_path(F.col("s"), "a.b_c[0].d"), s=doc) == "1"
    assert one(spark, settings.get_path(F.col("s"), "a.x", default=F.lit("none")), s=doc) == "none"
    assert one(spark, settings.get_setting(F.col("s"), "a", "bC"), s=doc) == '[{"d":1}]'
    with pytest.raises(Exception, match="not found"):
        one(spark, settings.get_path(F.col("s"), "a.x", strict=True), s=doc)
    assert one(spark, settings.keys_converted(F.col("s"), "camel"), s='{"a_b":[{"c_d":"x_y"}],"e_1":null}') == '{"aB":[{"cD":"x_y"}],"e_1":null}'


def test_folds_cross_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(k % 2, k, float(k)) for k in range(40)]
        frame = spark.createDataFrame(rows, "u long, ts long, v double")
        got = {(r["u"], r["ts"]) for r in folds.throttle(frame, "u", ["ts"], "ts", 10).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(u, t) for u in (0, 1) for t in range(u, 40, 10)}


def test_settings_documents(spark):
    put = lambda doc, path, value: one(spark, settings.set_path(F.col("d"), path, F.col("v")), d=doc, v=value)
    assert put('{"a":{"b":1}}', "a.c", "[1]") == '{"a":{"b":1,"c":[1]}}'
    assert put("{}", "a[1].b", "2") == '{"a":[null,{"b":2}]}'
    assert put('{"a":1}', "a.b", "2") is None
    assert put('{"a":{"b":null},"z":"x"}', "a.b.c", '"y"') == '{"a":{"b":{"c":"y"}},"z":"x"}'
    nothing = spark.createDataFrame([(None, None)], "d string, v string")
    assert nothing.select(settings.set_path(F.col("d"), "a", F.col("v"))).first()[0] == '{"a":null}'
    assert put('{"a":[1]}', "a.b", "2") is None
    merged = one(spark, settings.deep_merged(F.col("a"), F.col("b")), a='{"x":{"y":1,"z":[1]},"k":1}', b='{"x":{"z":[2]},"n":null}')
    assert merged == '{"k":1,"n":null,"x":{"y":1,"z":[2]}}'


def _plain_mentions(texts, names):
    word = lambda c: unicodedata.category(c) in {"Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "Pc"}
    out = {}
    for i, text in enumerate(texts):
        inside = [False, *map(word, text), False]
        for k, name in enumerate(names):
            at = n = 0
            while (p := text.find(name, at)) >= 0:
                end = p + len(name)
                whole = inside[p] != inside[p + 1] and inside[end] != inside[end + 1]
                n, at = (n + 1, end) if whole else (n, p + 1)
            if n:
                out[i, k] = n
    return out


@pytest.mark.parametrize("seed", range(40))
def test_automaton_counts_like_plain_search(seed, monkeypatch):
    rng = random.Random(seed)
    letters = rng.choice(["ab ", "ab#. ", "aäß 中!", "ab_\n-"])
    names = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 15))})
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 60, 300]))) for _ in range(6)]
    monkeypatch.setattr(M, "_STRETCH", rng.choice([4, 16, 1024]))
    text, name, n = M.Automaton(names).counts(texts)
    assert dict(zip(zip(text.tolist(), name.tolist()), n.tolist())) == _plain_mentions(texts, names)


def test_mentions_by_shards_and_by_join_agree(spark):
    rng = random.Random(4)
    words = ["The", "the", "a-b", "Straße", "C++", "#tag", "x y", "\\E", "naïve", "中文", "a", "a a"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", ".", "\n"]) for _ in range(40))) for i in range(30)] + [(100, None), (101, "")]
    files = spark.createDataFrame(rows, "id long, content string").repartition(3)
    names = C.vocabulary(spark.createDataFrame([(w,) for w in [*words, None, "", "unseen"]], "w string"), "w")
    low = [(i, (t or "").lower()) for i, t in rows]
    want = {(low[i][0], w, n) for w in words for (i, _), n in _plain_mentions([t for _, t in low], [w.lower()]).items()}
    for found in (M.scanned_mentions(files, names, "id", "content", 1), M.scanned_mentions(files, names, "id", "content", 5), M.joined_mentions(files, names, "id", "content"), C.mentions(files, names, "id")):
        assert {tuple(r) for r in found.collect()} == want
    assert C.mentions(files, names.limit(0), "id").count() == 0


def test_page_index_reads_few_files_and_survives(spark, tmp_path):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("id"), F.lit("x").alias("_label"))
    index = PageIndex.build(rows, "id", f"file://{tmp_path}/pages")
    again = PageIndex.open(spark, f"file://{tmp_path}/pages")
    assert again.parts == index.parts and again.total == 1000
    for number in (1, 2, 37, 50):
        page, about = again.page(number, 20)
        assert sorted(r["id"] for r in page.collect()) == list(range(20 * number - 20, 20 * number))
        assert about == {"total": 1000, "total_pages": 50, "page": number}
        touched = page.select(F.input_file_name().alias("f")).distinct().count()
        assert touched <= 2
        assert "PartitionFilters: [" in page._jdf.queryExecution().toString()
    nothing = PageIndex.build(rows.limit(0), "id", f"file://{tmp_path}/none")
    assert nothing.page(1, 20)[0].count() == 0 and nothing.page(1, 20)[1]["total_pages"] == 0
    with pytest.raises(ValueError):
        again.page(51, 20)


def _random_json(rng, level=0):
    kind = rng.random()
    if level < 6 and kind < 0.45:
        return {rng.choice(["a", "b_c", "dE", 'x"y', "q.r", ""]): _random_json(rng, level + 1) for _ in range(rng.randint(0, 3))}
    if level < 6 and kind < 0.65:
        return [_random_json(rng, level + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([1, -2, 0.5, True, None, "s", "{[", '"', "\\", "ü", "]"])


def _plain_merge(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return a | {k: _plain_merge(a[k], v) if k in a else v for k, v in b.items()}
    return b


def _plain_put(root, steps, value):
    root = at = {} if root is None else root
    for step, following in zip(steps, [*steps[1:], None]):
        if isinstance(step, int) != isinstance(at, list) or not isinstance(at, (dict, list)):
            return None
        if isinstance(step, int):
            at.extend([None] * (step + 1 - len(at)))
        if following is None:
            at[step] = value
        else:
            held = at[step] if isinstance(step, int) else at.get(step)
            if held is None:
                at[step] = [] if isinstance(following, int) else {}
            at = at[step]
    return root


def _plain_snake(v):
    if isinstance(v, dict):
        return {re.sub("[A-Z]", lambda m: "_" + m.group().lower(), k): _plain_snake(x) for k, x in v.items()}
    return [_plain_snake(x) for x in v] if isinstance(v, list) else v


def test_documents_of_any_depth(spark):
    """Written again, merged, set at a path and with other keys, against plain Python."""
    docs = [tuple(json.dumps(_random_json(random.Random(i + k))) for k in (0, 10_000)) for i in range(300)]
    docs.append(('{"a":{"b":{"c":{"d":{"e":[]}}}}}', '{"a":{"b":{"c":{"d":{"f":{}}}}}}'))
    frame = spark.createDataFrame(docs, "a string, b string")
    value = F.lit('{"k":[1]}')
    rows = frame.select(
        "a", "b",
        documents.written(documents.leaves(F.col("a"))).alias("same"),
        settings.deep_merged(F.col("a"), F.col("b")).alias("merged"),
        settings.set_path(F.col("a"), "a.b_c[2].z", value).alias("set"),
        settings.keys_converted(F.col("a"), "snake").alias("snake"),
    ).collect()
    for r in rows:
        a, b = json.loads(r["a"]), json.loads(r["b"])
        assert json.loads(r["same"]) == a
        assert json.loads(r["merged"]) == _plain_merge(a, b)
        assert json.loads(r["snake"]) == _plain_snake(a)
        want = _plain_put(json.loads(r["a"]), ["a", "b_c", 2, "z"], {"k": [1]})
        assert (None if r["set"] is None else json.loads(r["set"])) == want


def test_undo_history_against_a_plain_stack(spark):
    rng = random.Random(9)
    events = [(k, i, rng.choice(["set", "set", "set", "undo", "undo", "redo", "clear" if i % 40 == 0 else "redo"]), str(rng.randint(0, 3))) for k in (1, 2, None) for i in range(200)]
    frame = spark.createDataFrame(events, "k long, i long, action string, v string").repartition(4)
    got = {(r["k"], r["i"]): (r["current"], r["position"], r["entries"], r["can_undo"], r["can_redo"]) for r in folds.undo_history(frame, "k", ["i"], "action", "v", 5).collect()}
    for k in (1, 2, None):
        entries, cursor, last = [], -1, None
        for _, i, action, v in (e for e in events if e[0] == k):
            if action == "set" and v != last:
                entries = (entries[: cursor + 1] + [v])[-5:]
                cursor, last = len(entries) - 1, v
            elif action == "undo" and cursor > 0:
                cursor -= 1
            elif action == "redo" and cursor < len(entries) - 1:
                cursor += 1
            elif action == "clear":
                entries, cursor, last = [], -1, None
            assert got[k, i] == (entries[cursor] if entries else None, cursor + 1, len(entries), cursor > 0, cursor < len(entries) - 1)


def test_white_space_of_any_kind(spark):
    turns = spark.createDataFrame([("\n\t",), ("  ",), ("\u3000\u00a0",), (None,), ("",), (" a",)], "text string")
    assert [r["text"] for r in folds.transcripts(turns).collect()] == [" a"]
    assert one(spark, X.csv_list(F.col("c")), c="a,\tb\n, \t ,\u00a0c") == ["a", "b", "c"]
    assert one(spark, X.is_public(F.col("c")), c="\u3000" * 29 + "public:: true") is True
    assert one(spark, X.is_public(F.col("c")), c="\u3000" * 30 + "public:: true") is False
    assert one(spark, X.is_public(F.col("c")), c="public:: true" + "\u3000" * 30) is True
    assert one(spark, X.snake(F.col("c")), c="enableSSAO-x") == "enable_s_s_a_o_x"


def test_checked_set_says_what_is_wrong(spark):
    types = {"a.n": "number", "a.s": "string"}
    doc = '{"a":{"n":1,"s":"x"},"b":null,"c":[1]}'
    put = lambda path, v: one(spark, settings.checked_set(F.col("d"), path, F.col("v"), types), d=doc, v=v)
    assert put("a.n", "2.5")["error"] is None and json.loads(put("a.n", "2.5")["settings"])["a"]["n"] == 2.5
    assert json.loads(put("x.y.z", "1")["settings"])["x"] == {"y": {"z": 1}}
    for path, value, error in [("a.n", '"w"', "wrong type: a.n"), ("a", "{}", "wrong type: a.n"), ("a.n.q", "1", "not an object: n"), ("b.q", "1", "not an object: b"), ("c.q", "1", "not an object: c")]:
        assert put(path, value) == (doc, error)


def _cloud(spark, seed, n=400):
    rng = np.random.default_rng(seed)
    nodes = [(int(i), *map(float, rng.normal(0, 3, 3)), *map(float, rng.normal(0, 0.1, 3)), int(rng.integers(1, 40)), "kept") for i in range(n)]
    edges = [(int(a), int(b), 1.5) for a, b in rng.integers(0, n, (n, 2)) if a != b] + [(0, 9999, 1.0)] + [(0, int(b), 0.5) for b in range(1, 60)]
    return spark.createDataFrame(nodes, "id long, x double, y double, z double, vx double, vy double, vz double, mass int, label string"), spark.createDataFrame(edges, "source long, target long, weight double")


@pytest.mark.parametrize("options", [{"block": 20}, {"block": 2000, "skin": 0.0}, {"block": 7, "side": 9.0, "skin": 0.4}])
def test_blocks_step_like_single_steps(spark, options):
    nodes, edges = _cloud(spark, 5)
    params = layout.Params()
    want = {r["id"]: r for r in layout.run_steps(nodes, edges, params, 3).collect()}
    got = block_layout.run_in_blocks(nodes, edges, params, 3, **options)
    assert got.columns == nodes.columns
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        assert all(abs(r[c] - want[r["id"]][c]) < 1e-9 for c in ("x", "y", "z", "vx", "vy", "vz")) and r["label"] == "kept"


def test_crowded_nodes_are_not_sent_to_every_block(spark):
    nodes, edges = _cloud(spark, 7)
    nodes = nodes.withColumns({c: F.col(c) * 0.1 for c in ("x", "y", "z")})  # all reach each other
    params = layout.Params(repulsion=500.0)
    run = block_layout.BlockLayout(nodes, edges, params, block=4)
    sent = 0 if run.now is None else run.now.filter("to IS NOT NULL").agg(F.sum(F.size("id"))).first()[0]
    assert sent <= layout.MOST_TILES * nodes.count()
    want = {r["id"]: r for r in layout.run_steps(nodes, edges, params, 3).collect()}
    rows = run.advance(3).nodes(nodes).collect()
    assert run.dealt and len(rows) == len(want)  # they spread, and blocks take over
    for r in rows:
        assert all(abs(r[c] - want[r["id"]][c]) < 1e-9 * max(1.0, abs(want[r["id"]][c])) for c in ("x", "y", "z", "vx", "vy", "vz")) and r["label"] == "kept"


def test_a_step_of_blocks_shuffles_lists_only(spark):
    nodes, edges = _cloud(spark, 6)
    run = block_layout.BlockLayout(nodes, edges, layout.Params(), block=30)
    assert run.advance(2).dealt >= 1
    state = run.now.filter("to IS NULL").drop("to", "drift").join(run.fixed, "block")
    assert "Exchange hashpartitioning" not in state._jdf.queryExecution().executedPlan().toString()
    assert block_layout.run_in_blocks(nodes.limit(0), edges, layout.Params(), 2).count() == 0


def test_blocks_of_a_long_box_send_few_of_their_nodes(spark):
    rng = np.random.default_rng(9)
    nodes = [(i, *map(float, rng.uniform(-2, 2, 2)), float(rng.uniform(0, 250)), 0.0, 0.0, 0.0, int(rng.integers(1, 40))) for i in range(4000)]
    nodes = spark.createDataFrame(nodes, "id long, x double, y double, z double, vx double, vy double, vz double, mass int")
    edges, params = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "source long, target long, weight double"), layout.Params()
    run = block_layout.BlockLayout(nodes, edges, params, block=200)
    sent = run.now.filter("to IS NOT NULL").agg(F.sum(F.size("id"))).first()[0]
    assert 0 < sent < nodes.count()
    want = {r["id"]: r for r in layout.run_steps(nodes, edges, params, 2).collect()}
    for r in run.advance(2).nodes(nodes).collect():
        assert all(abs(r[c] - want[r["id"]][c]) < 1e-9 * max(1.0, abs(want[r["id"]][c])) for c in ("x", "y", "z", "vx", "vy", "vz"))


def test_index_finds_what_the_scan_finds(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéX ") for _ in range(rng.randint(0, 8)))
    rows = [(i, word(), rng.choice([None, word()]), rng.choice([None, [word(), word()], []]), rng.choice([True, False, None])) for i in range(300)]
    commands = spark.createDataFrame(rows, "id long, title string, description string, keywords array<string>, enabled boolean")
    index = SearchIndex.build(commands, f"file://{tmp_path}/index", 8)
    key = lambda df: [(r["id"], r["title"], round(r["score"], 9)) for r in df.collect()]
    for query in ("a", "ab", "abc", "Xa", "é", "bcde", "d b", "  ", "zz"):
        found, scored = index.search(query)
        assert sorted(key(found)) == sorted(key(search.command_search(commands, query)))
        assert scored < 300
    assert index.search("zz")[1] == 0


@pytest.mark.parametrize("n, box", [(1, 5.0), (300, 4.0), (1200, 40.0)])
def test_tree_forces_are_within_their_bound(spark, n, box):
    rng = np.random.default_rng(n)
    rows = [(int(i), *map(float, rng.uniform(-box, box, 3)), float(rng.uniform(0.1, 1.0))) for i in range(n)]
    nodes, params = spark.createDataFrame(rows, "id long, x double, y double, z double, m double"), layout.Params()
    exact = {r["id"]: np.array([r["fx"], r["fy"], r["fz"]]) for r in layout.all_pairs_forces(nodes, params, 40, 256).collect()}
    got = far_field.tree_forces(nodes, params, 40, tile=200).collect()
    assert {r["id"] for r in got} == set(exact)
    for r in got:
        off = np.linalg.norm(np.array([r["fx"], r["fy"], r["fz"]]) - exact[r["id"]])
        assert off <= r["bound"] + 1e-9 and off <= 0.002 * np.linalg.norm(exact[r["id"]]) + 1e-6
    with pytest.raises(ValueError):
        far_field.tree_forces(nodes, params, 40, side=1.0)


def test_tree_step_moves_like_all_pairs(spark):
    nodes, _ = _cloud(spark, 8, 200)
    nodes = nodes.withColumns({c: F.col(c) * 6.0 for c in "xyz"})
    want = {r["id"]: r for r in layout.all_pairs_step(nodes, layout.Params(), 40).collect()}
    for r in far_field.tree_step(nodes, layout.Params(), 40).collect():
        assert all(abs(r[c] - want[r["id"]][c]) < 1e-3 for c in ("x", "y", "z", "vx", "vy", "vz"))


def _balanced(n):
    """Places and masses, of which the first one is where the forces of all others cancel."""
    rng = np.random.default_rng(n)
    place, mass = rng.normal(0, 12, (3, n)) * np.array([[1.0], [0.8], [0.6]]), rng.uniform(0.1, 1.0, n)
    mass[0] = 1.0
    force = lambda at: layout.dense_forces(layout.all_pairs_act(layout.Params(), 40)[1], np.r_[at, 1.0][:, None], np.r_[place, mass[None]][:, 1:])[0][:, 0]
    at = np.array([0.5, 0.4, 0.3])
    for _ in range(60):
        slope = np.stack([(force(at + step) - force(at - step)) / 2e-5 for step in np.eye(3) * 1e-5], 1)
        at = at - np.clip(np.linalg.solve(slope, force(at)), -0.5, 0.5)
    place[:, 0] = at
    return [(i, *map(float, p), float(m)) for i, (p, m) in enumerate(zip(place.T, mass))], np.linalg.norm(force(at))


def test_tree_forces_are_near_where_all_forces_cancel(spark):
    rows, least = _balanced(3000)
    assert least < 1e-3
    rows += [(3000, None, 1.0, 2.0, 0.5), (3001, float("nan"), 1.0, 2.0, 0.5)]
    nodes = spark.createDataFrame(rows, "id long, x double, y double, z double, m double")
    exact = {r["id"]: np.array([r["fx"], r["fy"], r["fz"]]) for r in layout.all_pairs_forces(nodes, layout.Params(), 40).collect()}
    got = far_field.tree_forces(nodes, layout.Params(), 40, share=0.01).collect()
    assert sorted(r["id"] for r in got) == sorted(exact)
    taken = 0
    for r in got:
        off = np.linalg.norm(np.array([r["fx"], r["fy"], r["fz"]]) - exact[r["id"]])
        assert off <= r["bound"] + 1e-9 and off <= 0.01 * np.linalg.norm(exact[r["id"]]) + 1e-9
        taken += r["bound"] > 0.0
    assert taken > 2500  # few nodes meet all others
