import hashlib
import random

import pytest

from loomgraph.llm.exact_dedup import exact_dedup


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(low(t), []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = groups[low(t)]
        best = max((x for x in ids if x is not None), default=None)
        out.append((i, best, len(ids), i == best, hashlib.sha256(low(t).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("bits", [256, 4])
def test_equals_brute_force(spark, bits):
    rng = random.Random(bits)
    pool = ["", "Éa", "éa", "ABC", "abc", "x" * 50_000, "Straße", "STRASSE", None] + [f"text {k}" for k in range(40)]
    rows = [(k, rng.choice(pool), "clash", "n") for k in range(300)] + [(None, "abc", "c", "n"), (None, "only null ids", "c", "n"), (7, "abc", "c", "n"), (7, "abc", "c", "n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, digest string, norm string").repartition(6)
    got = exact_dedup(frame, salts=3, digest_bits=bits).collect()
    key = repr
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got], key=key) == sorted(brute(rows), key=key)


def test_kept_columns_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "A", "x"), (2, "a", "y")], "doc_id long, text string, digest string")
    got = {r["doc_id"]: (r["digest"], r["text"], r["kept"]) for r in exact_dedup(frame, keep=["digest", "text"]).collect()}
    assert got == {1: ("x", "A", False), 2: ("y", "a", True)}
    assert exact_dedup(frame.limit(0)).count() == 0


def test_kept_columns_must_not_clash(spark):
    with pytest.raises(ValueError):
        exact_dedup(spark.createDataFrame([(1, "a", True)], "doc_id long, text string, kept boolean"), keep=["kept"])
