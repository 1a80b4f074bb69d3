import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomgraph.llm.merkle import build, folded, op13_merkle, proof_digest, prove

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, rank long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    return H(*(field(v) for v in row[:5]))


def climb(nodes):
    """(top, per node the list of (before, after) per level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            run = nodes[place // 16 * 16 : place // 16 * 16 + 16]
            paths[k].append(("".join(run[: place % 16]), "".join(run[place % 16 + 1 :])))
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at = [place // 16 for place in at]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops, inner = [], {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, paths = climb([leaf(r) for r in groups[s]])
        tops.append(top)
        inner[s] = paths
    root, upper = climb(tops)
    out = []
    for k, s in enumerate(names):
        for r, path in zip(groups[s], inner[s]):
            path = path + upper[k]
            x = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                x = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for b, a in path:
                x = H(b, x, a)
            out.append((r[0], leaf(r), tops[k], root, H(*(b + a for b, a in path)), x, x == root))
    return sorted(out, key=repr)


def table(n, seed):
    rng = random.Random(seed)
    sources = ["hot"] * 60 + ["é", "Z", "a", None, ""] + [f"s{i}" for i in range(20)]
    rows = [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([3, None]), rng.choice([None, "", "Abc", "ÄÖ X" * 50, "plain"]), "x", 1) for i in range(n)]
    return rows + [(None, "hot", None, None, "No Id", "x", 1), (3, "hot", None, 1, "Again", "x", 1), (3, "hot", None, 1, "Again", "x", 1), (99999, "alone", "en", 1, "x" * 100_000, "x", 1)]


def query(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, op13_merkle(spark, str(tmp_path)).collect()), key=repr)


@pytest.mark.parametrize("n", [40, 700])
def test_equals_brute_force(spark, tmp_path, n):
    rows = table(n, n)
    assert query(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 16, 17, 257])
def test_one_source(spark, tmp_path, n):
    rows = [(i, "only", "en", 1, f"T{i}", "x", 1) for i in range(n)]
    assert query(spark, tmp_path, rows) == (brute(rows) if rows else [])


def test_each_source_with_one_document(spark, tmp_path):
    rows = [(i, f"s{i}", "en", 1, f"T{i}", "x", 1) for i in range(20)]
    assert query(spark, tmp_path, rows) == brute(rows)


def test_some_requests_and_their_records(spark):
    rows = table(300, 5)
    manifest = build(spark.createDataFrame(rows, SCHEMA).repartition(3))
    asked = manifest.leaves.filter("doc_id % 50 = 7")
    proved = prove(manifest, asked).select("doc_id", "leaf", "subroot", F.lit(manifest.root).alias("root"), proof_digest(F.col("path")).alias("p"), folded(F.col("leaf"), F.col("path")).alias("f")).collect()
    want = {r[0]: r[1:5] for r in brute(rows)}
    assert len(proved) == 6
    for r in proved:
        assert want[r["doc_id"]] == (r["leaf"], r["subroot"], r["root"], r["p"]) and r["f"] == manifest.root
    for r in manifest.records.collect():
        assert r["digest"] == H(*r["children"]) and 1 <= len(r["children"]) <= 16
