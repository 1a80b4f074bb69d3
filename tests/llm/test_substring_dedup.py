import hashlib
import random

import pytest

from loomgraph.llm import substring_dedup as sd


def brute(rows, length):
    """rows: (id, text) in order; (removed spans, kept bytes) of each."""
    seen, marks = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        mark = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                mark[i : i + length] = b"\1" * length
            seen.add(s)
        marks.append((raw, mark))
    return [
        (sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark)), sum(mark), bytes(c for c, m in zip(raw, mark) if not m))
        for raw, mark in marks
    ]


def compare(spark, rows, length, anchor):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, list int").repartition(5)
    got = sorted(sd.remove_repeats(frame, length=length, anchor=anchor).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    expected = brute(rows, length)
    found = [(len(r["spans"]), sum(s["end"] - s["start"] for s in r["spans"]), bytes(r["kept"])) for r in got]
    if len({r[0] for r in rows}) < len(rows):
        found, expected = sorted(found), sorted(expected)
    assert found == expected


def made(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    texts = []
    for k in range(n):
        if texts and rng.random() < 0.5:
            t = list(rng.choice(texts))
            for _ in range(rng.randint(0, 3)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice("xyz")
            texts.append("".join(t))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))))
    texts += ["a" * 90, "ab" * 60, "a" * 45, "", "short", "abc" * 50]
    return [(3 * k, t) for k, t in enumerate(texts)] + [(1, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    compare(spark, made(seed), 30, 8)


@pytest.mark.parametrize("group", [1, 2, 5])
def test_crowded_anchors_and_strips(spark, monkeypatch, group):
    monkeypatch.setattr(sd, "GROUP", group)
    monkeypatch.setattr(sd, "_STRIDE", 64)
    compare(spark, made(3), 30, 8)


def test_crowded_passage_in_different_surroundings(spark, monkeypatch):
    """One passage in every document, so that its anchors have as many fragments as documents."""
    monkeypatch.setattr(sd, "GROUP", 8)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9)))
    passage = " ".join(word() for _ in range(9))
    rows = [(k, " ".join([*(word() for _ in range(k % 5)), passage[: rng.randint(35, len(passage))], *(word() for _ in range(4))])) for k in range(80)]
    compare(spark, rows, 30, 8)


@pytest.mark.parametrize("seed", [5, 6])
def test_documents_that_end_inside_a_repeat(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(40):
        passage = "".join(rng.choice("abcdefgh") for _ in range(70))
        for _ in range(6):
            cut = passage[: rng.randint(31, 70)]
            rows.append(cut if rng.random() < 0.6 else cut + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))))
    rng.shuffle(rows)
    compare(spark, list(enumerate(rows)), 30, 8)


def test_a_text_that_ends_hides_no_longer_repeat():
    """b ends after 49 of the 50 bytes that a and c share; the next text continues b between a and c."""
    import numpy as np

    from loomgraph.llm.suffix import repeats_in

    shared = "".join(random.Random(8).choice("cdefgh") for _ in range(49))
    texts = [(shared + "ma").encode(), (shared + "mz").encode(), shared.encode(), b"mm" + b"q" * 40]
    found = repeats_in(texts, np.array([len(t) - 29 for t in texts]), 30)[4]
    assert 50 in found[:, 0]


def test_null_and_repeated_ids(spark):
    rows = made(4, 20)
    compare(spark, rows + [(None, rows[3][1]), (None, "q" * 70), (6, rows[5][1]), (6, rows[5][1])], 30, 8)


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_groups_hold_all_occurrences(spark):
    passage = "".join(random.Random(9).choice("abcdefgh ") for _ in range(60))
    frame = spark.createDataFrame([(k, f"{k} head {k * k} " + passage + f" tail {k}") for k in range(5)], "doc_id long, text string")
    groups = {}
    for r in sd.repeat_groups(frame, length=40, anchor=10).collect():
        groups.setdefault(r["repeat_id"], set()).add(r["doc_id"])
    assert {0, 1, 2, 3, 4} in groups.values()


def occurrences(texts, part):
    found = []
    for i, t in texts:
        at = t.find(part)
        while at >= 0:
            found.append((i, at))
            at = t.find(part, at + 1)
    return sorted(found)


@pytest.mark.parametrize("group", [2048, 2])
def test_groups_list_every_occurrence(spark, monkeypatch, group):
    """Identical documents, a passage in many surroundings and one inside a document twice."""
    monkeypatch.setattr(sd, "GROUP", group)
    rng = random.Random(31)
    line = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    copy, passage = line(120), line(60)
    texts = [(k, copy) for k in range(6)] + [(10 + k, line(20) + passage + line(25)) for k in range(7)] + [(30, passage + line(9) + passage)]
    byte_of = dict(texts)
    groups = {}
    for r in sd.repeat_groups(spark.createDataFrame(texts, "doc_id long, text string"), length=40, anchor=10).collect():
        assert r["start"] + r["length"] <= len(byte_of[r["doc_id"]])
        groups.setdefault((r["repeat_id"], r["length"]), []).append((r["doc_id"], r["start"]))
    covered = {k: set() for k, _ in texts}
    for (_, length), found in groups.items():
        i, at = found[0]
        assert sorted(found) == occurrences(texts, byte_of[i][at : at + length])  # all of them, and nothing else
        for i, at in found:
            covered[i].update(range(at, at + length))
    assert all(covered[k] == set(range(120)) for k in range(6))
    assert all(set(range(20, 80)) <= covered[10 + k] for k in range(7)) and len(covered[30]) >= 120


def test_ids_that_are_no_numbers(spark):
    text = "".join(random.Random(5).choices("abcdefgh", k=50))
    frame = spark.createDataFrame([("b", text), ("a", text), (None, "y")], "doc_id string, text string")
    got = {r["doc_id"]: len(r["kept"]) for r in sd.remove_repeats(frame, length=40, anchor=10).collect()}
    assert got == {"a": 50, "b": 0, None: 1}
    assert {r["doc_id"] for r in sd.repeat_groups(frame, length=40, anchor=10).collect()} == {"a", "b"}
    assert sd.repeat_groups(frame.limit(0), length=40, anchor=10).count() == 0
