import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import fuzzy_hash as Z


def plain_cuts(data: bytes) -> list:
    out = []
    for i in range(len(data)):
        total = mixed = 0
        for back in range(7):
            if i - back >= 0:
                total += data[i - back] * (8 - back)
                mixed ^= data[i - back] << 5 * back & 0xFFFFFFFF
        out.append((total + mixed) & 0xFFFFFFFF)
    return out


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=80))
def test_rolling_hash(data):
    assert Z._rolling(np.frombuffer(data, np.uint8)).tolist() == plain_cuts(data)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=90), st.text("abcd", max_size=90))
def test_edit_distance(a, b):
    assert len(a) + len(b) - 2 * Z._common(list(a), list(b)) == plain_distance(a, b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 400), max_size=30, unique=True), st.integers(1, 50))
def test_long_stretches_are_cut(cuts, longest):
    ends = np.array(sorted(cuts) + [401])
    want, at = [], 0
    for end in ends.tolist():
        while end - at > longest:
            at += longest
            want.append(at)
        want.append(end)
        at = end
    assert Z._ends(ends, longest).tolist() == want


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=300), st.text(max_size=300))
def test_likeness_is_symmetric_and_bounded(a, b):
    p, q = Z.fingerprint(a), Z.fingerprint(b)
    assert p == Z.fingerprint(a)
    assert 0 <= Z.likeness(p, q) <= 1 and Z.likeness(p, q) == Z.likeness(q, p) and Z.likeness(p, p) == 1


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_edits_stay_alike_and_others_do_not():
    rng = random.Random(3)
    for n in (60, 400, 3000, 30_000):
        text = words(rng, n)
        mark = Z.fingerprint(text)
        inner = text[: len(text) // 2] + words(rng, 4) + text[len(text) // 2 :]
        tail = text[: 2 * len(text) // 3] + words(rng, n)[: len(text) // 3]
        assert Z.likeness(mark, Z.fingerprint(inner)) > 0.8
        assert Z.likeness(mark, Z.fingerprint(tail)) > 0.4
        assert Z.likeness(mark, Z.fingerprint(words(rng, n))) < 0.2


def brute(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for i, (doc, text) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        marks = [Z.fingerprint(t) for t in (text, edited, after)]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1], Z.likeness(marks[0], marks[1]), Z.likeness(marks[0], marks[2])))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(i * 3 - 50, rng.choice([None, "", "ü", "ab", "x" * 10_000, words(rng, 50), words(rng, 5)])) for i in range(90)]
    for parts in (1, 7):
        frame = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, kind string, _part int").repartition(parts)
        assert sorted((tuple(r) for r in Z.fingerprints(frame).collect()), key=repr) == brute(rows)


def test_small_tables(spark):
    schema = "doc_id long, text string"
    assert Z.fingerprints(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(1, "alone and long enough")], [(1, "one"), (None, "no id")], [(2, "same"), (2, "same"), (2, "same")]):
        assert sorted((tuple(r) for r in Z.fingerprints(spark.createDataFrame(rows, schema)).collect()), key=repr) == brute(rows)
