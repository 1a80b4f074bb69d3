"""Readers, writers and streaming forms."""

import hashlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import folds
from loomgraph.sources import stores, tables
from loomgraph.streaming import ingest, stateful


def test_listing_and_metadata(spark, tmp_path):
    (tmp_path / "docs" / "sub").mkdir(parents=True)
    (tmp_path / "docs" / "a.md").write_text("public:: true é")
    (tmp_path / "docs" / "sub" / "b.md").write_text("x")
    (tmp_path / "docs" / "c.txt").write_text("no")
    found = {r["file_name"]: (r["file_size"], r["content"]) for r in tables.listing(spark, str(tmp_path / "docs")).collect()}
    assert found == {"a.md": (16, "public:: true é"), "b.md": (1, "x")}
    path = str(tmp_path / "metadata")
    assert tables.load_metadata(spark, path).count() == 0
    rows = tables.listing(spark, str(tmp_path / "docs")).select(
        "file_name", "file_size", F.lit(5.0).alias("node_size"), F.lit(1).cast("long").alias("hyperlink_count"), F.sha1("content").alias("sha1"), F.lit("3").alias("node_id"), F.lit(None).cast("timestamp").alias("last_modified"), F.create_map(F.lit("b"), F.lit(2).cast("long")).alias("topic_counts")
    )
    tables.save_metadata(rows, path)
    assert {(r["file_name"], r["topic_counts"]["b"]) for r in tables.load_metadata(spark, path).collect()} == {("a.md", 2), ("b.md", 2)}


def test_layout_snapshot(spark, tmp_path):
    (tmp_path / "layout.json").write_text(json.dumps([["1", 1.5, -2.0, 0.25], ["2", 0, 0, 1e-3]]))
    assert [tuple(r) for r in tables.layout_snapshot(spark, str(tmp_path / "layout.json")).collect()] == [("1", 1.5, -2.0, 0.25), ("2", 0.0, 0.0, 0.001)]


def finished(frame, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return frame.sparkSession.table(name)


def test_deadband_stream_equals_batch(spark, tmp_path):
    rows = [(k % 3, k, float(k * k % 17), 0.0, 0.0) for k in range(60)]
    spark.createDataFrame(rows, "id long, seq long, x double, y double, z double").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id long, seq long, x double, y double, z double").parquet(str(tmp_path / "in"))
    got = {(r["id"], r["seq"]) for r in finished(stateful.deadband_stream(source, 4.0), "banded").collect()}
    batch = spark.createDataFrame(rows, "id long, seq long, x double, y double, z double").withColumn("v", F.lit(0.0))
    assert got == {(r["id"], r["seq"]) for r in folds.deadband(batch, "id", ["seq"], ["x", "y", "z"], ["v"], 4.0, 1.0).collect()}


def test_windows_and_presence(spark, tmp_path):
    rows = [(f"2024-01-01 00:{k:02d}:00", k % 2, "view") for k in range(0, 50, 2)] + [("2024-01-02 00:00:00", 0, "end")]
    schema = "t string, user_id long, event_type string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("t").cast("timestamp"))
    counted = finished(stateful.windowed_counts(source), "windows").filter("event_type = 'view'").agg(F.sum("n")).first()[0]
    assert counted == 25
    sessions = finished(stateful.presence_sessions(source, "3 minutes"), "sessions").collect()
    assert sum(r["updates"] for r in sessions) == 25 and {r["user_id"] for r in sessions} == {0}


def test_presence_has_a_time_to_live(spark, tmp_path):
    """User 1 falls silent and is forgotten; user 2 keeps the latest update although an older one comes later."""
    batches = [[(0, 1, 1), (0, 2, 2)], [(20, 2, 4), (15, 2, 3)], [(100, 2, 5)], [(101, 2, 6)]]
    for k, rows in enumerate(batches):
        made = [(f"2024-01-01 00:{t // 60:02d}:{t % 60:02d}", u, s, float(s)) for t, u, s in rows]
        spark.createDataFrame(made, "t string, user_id long, seq long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema("t string, user_id long, seq long, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    seen = finished(stateful.presence_stream(source.withColumn("ts", F.col("t").cast("timestamp")), "30 seconds", "1 second"), "presence", "append").collect()
    gone = [(r["user_id"], r["seq"]) for r in seen if not r["present"]]
    assert (1, 1) in gone and (2, 2) not in gone
    assert [r["seq"] for r in seen if r["user_id"] == 2 and r["present"]] == [2, 4, 5, 6]


@pytest.fixture
def rocks(spark):
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    yield spark
    spark.conf.set(name, before)


EVENTS = "k long, i long, t double, a boolean, x double, y double, z double, v double, action string, s string"
FOLDS = {
    "deadband": folds.deadband_fold(["x", "y", "z"], ["v"], 4.0, 1.0),
    "throttle": folds.throttle_fold("t", 7.0),
    "adaptive_rate": folds.adaptive_rate_fold("v"),
    "smoothed": folds.smoothed_fold("x"),
    "hysteresis": folds.hysteresis_fold("v", "a"),
    "selection": folds.selection_fold("i"),
    "undo_history": folds.undo_history_fold("action", "s", 4),
}


@pytest.mark.parametrize("name", FOLDS)
def test_fold_streams_equal_tables(rocks, tmp_path, name):
    """From the beginning, and from a snapshot of the first third; the rest comes in many micro-batches."""
    spark, fold, rng = rocks, FOLDS[name], random.Random(name)
    rows = [(k % 4, k, float(k), rng.random() < 0.5, float(k * k % 17), 0.0, 1.0, rng.random(), rng.choice(["set", "undo", "redo"]), str(k % 3)) for k in range(90)]
    whole = spark.createDataFrame(rows, EVENTS)
    key = lambda r: repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r))
    want = sorted(map(key, fold.over(whole, "k", ["i"]).collect()))
    for begin in (0, 30):
        folder = tmp_path / f"{name}{begin}"
        for n in range(begin, 90, 20):
            spark.createDataFrame(rows[n : n + 20], EVENTS).coalesce(1).write.parquet(str(folder / str(n)))
            time.sleep(0.01)  # files are taken in the order of their times
        source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
        start = fold.states(spark.createDataFrame(rows[:begin], EVENTS), "k", ["i"]) if begin else None
        got = sorted(map(key, finished(stateful.fold_stream(source, "k", ["i"], fold, start), f"fold_{name}_{begin}").collect()))
        late = sorted(map(key, (r for r in fold.over(whole, "k", ["i"]).collect() if r["i"] >= begin)))
        assert got == late and (begin or got == want)


def test_debounce_stream_equals_table(rocks, tmp_path):
    spark, rng = rocks, random.Random(2)
    at, rows = 0, []
    for i in range(60):
        at += rng.choice([1, 2, 5, 9])
        rows.append((i % 3, i, float(at)))
    schema = "k long, i long, t double"
    for n in range(0, 60, 15):
        spark.createDataFrame(rows[n : n + 15], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
        time.sleep(0.01)
    spark.createDataFrame([(9, 99, at + 1000.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "z"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    events = source.withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))
    got = {r["i"] for r in finished(stateful.debounce_stream(events, "k", ["ts", "i"], "ts", "12 seconds"), "quiet").collect()} - {99}
    assert got == {r["i"] for r in folds.debounce(spark.createDataFrame(rows, schema), "k", ["t", "i"], "t", 12.0).collect()}


def test_bucket_store_rewrites_touched_buckets_only(spark, tmp_path):
    def stamps():
        return {p.name: (f.name for f in p.glob("*.parquet")) and tuple(sorted(f.name for f in p.glob("*.parquet"))) for p in (tmp_path / "s").iterdir() if p.is_dir()}

    store = stores.BucketStore.create(spark.range(1000).select("id", F.lit("old").alias("label"), F.col("id").alias("n")), f"file://{tmp_path}/s", buckets=16)
    before = stamps()
    changes = spark.createDataFrame([(3, "new", None), (5000, "added", 7), (3, "new", None)], "id long, label string, n long")
    done = store.upsert(changes)
    after = stamps()
    assert 1 <= len(done) <= 2 and {int(b.split("=")[1]) for b in after if after[b] != before.get(b)} == set(done)
    rows = {r["id"]: (r["label"], r["n"]) for r in store.rows().collect()}
    assert len(rows) == 1001 and rows[3] == ("new", None) and rows[5000] == ("added", 7) and rows[4] == ("old", 4)
    store.merge(spark.createDataFrame([(4, None, 9), (6000, "x", None)], "id long, label string, n long"))
    rows = {r["id"]: (r["label"], r["n"]) for r in store.rows().collect()}
    assert rows[4] == ("old", 9) and rows[6000] == ("x", None) and len(rows) == 1002
    store.delete(spark.range(0, 1000).select("id"))
    assert {r["id"] for r in store.rows().collect()} == {5000, 6000}
    assert store.upsert(changes.limit(0)) == []


def test_a_large_bucket_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "TASK_ROWS", 100)
    rows = spark.range(2000).select((F.col("id") % 3).alias("id"), F.col("id").alias("n"), F.create_map(F.lit("k"), F.col("id")).alias("m"))
    store = stores.BucketStore.create(rows, f"file://{tmp_path}/s", buckets=2)
    assert store.rows().groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 500
    assert sorted(r["n"] for r in store.rows().collect()) == list(range(2000))


def test_deleting_nodes_takes_their_edges(spark, tmp_path):
    edges = [(a, (a * 7 + k) % 100, float(k)) for a in range(100) for k in range(3)]
    frame = spark.createDataFrame(edges, "source long, target long, weight double")
    store = stores.GraphStore.create(spark.range(100).withColumn("label", F.lit("n")), frame, f"file://{tmp_path}/g", buckets=32)
    done = store.delete_nodes(spark.createDataFrame([(5,), (50,), (777,)], "id long"))
    assert len(done["nodes"]) <= 3 and len(done["by_source"]) < 32
    want = sorted(e for e in edges if not {5, 50} & set(e[:2]))
    assert {r["id"] for r in store.nodes.rows().collect()} == set(range(100)) - {5, 50}
    for side in (store.by_source, store.by_target):
        assert sorted(tuple(r) for r in side.rows().collect()) == want


def test_stores_leave_nothing_aside_and_take_few_buckets_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "MOST_ROWS", 30)
    aside = tmp_path / "aside"
    aside.mkdir()
    monkeypatch.setattr(tables, "scratch_path", lambda _, name: f"file://{aside}/{name}-{len(list(aside.iterdir()))}")
    written = []
    write = stores.BucketStore._write
    monkeypatch.setattr(stores.BucketStore, "_write", lambda self, rows, count, *rest: written.append(rows.count()) or write(self, rows, count, *rest))
    edges = [(f"{a}-{b}", a, b, 1) for a in range(60) for b in range(a + 1, 60) if (a * b) % 3 == 1]
    nodes = spark.range(60).withColumn("label", F.lit("n"))
    store = stores.GraphStore.create(nodes, spark.createDataFrame(edges, "id string, source long, target long, weight long"), f"file://{tmp_path}/g", buckets=8)
    assert max(written) < len(edges)  # not filled in one go
    store.nodes.upsert(spark.createDataFrame([(5, "new"), (700, "new")], "id long, label string"))
    written.clear()
    store.delete_nodes(spark.range(0, 60, 7).select("id"))
    assert max(written) <= 200 and len(written) > 8
    left = sorted(e for e in edges if e[1] % 7 and e[2] % 7)
    for side in (store.by_source, store.by_target):
        assert sorted(tuple(r) for r in side.rows().collect()) == left
    assert {r["id"]: r["label"] for r in store.nodes.rows().collect()} == {i: "new" if i in (5, 700) else "n" for i in [*range(60), 700] if i % 7 or i == 700}
    assert not [p for p in aside.rglob("*.parquet")]
    store.delete_nodes(nodes.select("id"))
    assert store.by_source.rows().count() == store.by_target.rows().count() == 0 and store.nodes.rows().count() == 1


def test_ingest_is_idempotent_and_replaces_changed_files(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    marker = "public:: true\n"

    def run(check):
        taker = ingest.Ingest(spark, f"file://{tmp_path}/store", buckets=4)
        taker.start(ingest.arriving(spark, f"file://{folder}", per_batch=2), str(tmp_path / check)).awaitTermination(120)
        kept = {r["file_name"]: (r["file_size"], r["sha1"]) for r in taker.kept.rows().collect()}
        return taker, kept, {r["file_name"]: r["reason"] for r in taker.aside.rows().collect()}

    for k in range(5):
        (folder / f"f{k}.md").write_text(marker + "x" * k)
    (folder / "private.md").write_text("no marker")
    (folder / "broken.md").write_bytes(b"public:: true \xff\xfe")
    (folder / "other.txt").write_text(marker)
    _, kept, aside = run("a")
    assert set(kept) == {f"f{k}.md" for k in range(5)} and aside == {"private.md": "not public", "broken.md": "not UTF-8"}
    names = lambda: sorted(str(p) for p in (tmp_path / "store").rglob("*.parquet"))
    before = names()
    taker, again, _ = run("b")  # all files once more
    assert again == kept and names() == before
    time.sleep(0.02)
    (folder / "later").mkdir()
    (folder / "later" / "f3.md").write_text(marker + "changed")
    (folder / "later" / "private.md").write_text(marker + "now public")
    _, kept, aside = run("a")
    assert kept["f3.md"] == (len(marker) + 7, hashlib.sha1((marker + "changed").encode()).hexdigest()) and "private.md" in kept and set(aside) == {"broken.md"}
