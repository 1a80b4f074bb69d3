import zlib

import pytest

from loomgraph.llm.bpe import public_path
from loomgraph.llm.packing import cutting_stock, pack


def verify(spark, rows, capacity=4096, **more):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_path())
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, ids int")
    pieces = pack(docs, capacity=capacity, **more).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    for doc_id, text, *_ in rows:
        ids = encoder.encode(text or "", add_special_tokens=False).ids + [2]
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        own = sorted(by_doc[doc_id], key=lambda p: p["start"])
        assert [p["start"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
        assert b"".join(bytes(p["ids"]) for p in own) == raw
        assert {p["doc_tokens"] for p in own} == {len(ids)}
    for own in by_seq.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
        assert sum(p["length"] for p in own) <= capacity
    total = sum(p["length"] for p in pieces)
    return len(by_seq), total


def test_pack_round_trip(spark):
    texts = [None, "", "a", "word " * 900, "x" * 3000] + [f"{k} some words {k * k} " * (1 + k * 7 % 90) for k in range(300)]
    rows = [(k, t, "clash", k) for k, t in enumerate(texts)]
    n, total = verify(spark, rows, capacity=256, width=8, filler_every=8)
    assert n <= total / 256 * 1.03 + 2


def test_pack_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cutting_stock_covers_counts():
    counts = {1: 50, 3: 1000, 5: 333, 7: 10, 11: 400, 16: 3}
    patterns = cutting_stock(counts, 16)
    for cls, n in counts.items():
        assert sum(p.get(cls, 0) * c for p, c in patterns) >= n
    assert all(sum(k * a for k, a in p.items()) <= 16 for p, _ in patterns)
    floor = sum(k * n for k, n in counts.items()) / 16
    assert sum(c for _, c in patterns) <= floor * 1.1 + 6


def test_width_must_divide(spark):
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([], "doc_id long, text string"), capacity=100, width=32)
