"""Operator 13: a Merkle manifest of a dataset, kept as digest-to-children records and proved by descent.

A document's leaf is the digest of its fields. The leaves of a source form a tree of runs of 16, its top is
the source's subroot, and the subroots form the upper part of the same tree. All nodes are stored as records
(digest, children) and addressed by content alone. A leaf's place is its path of digits from the root: those
of its source's number, then those of its rank. Requests go down together: at each level one row stands for
all requests with the same digits so far, finds its record by digest, and each wanted digit goes on with that
child, the unselected children being added to its path. Reversed, the path is the proof from leaf to root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import LOWER, UPPER, crc32_sql, looked_up, table, written
from loomgraph.llm.ranks import numbered, ranked

#: Children of a node.
RUN = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields in order, each as byte count, colon and value, or - for null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def height(n: int) -> int:
    """Levels above n leaves until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // RUN), levels + 1
    return levels


@dataclass
class Manifest:
    """records: (digest, children), the content-addressed nodes; leaves: a row per document with its place
    (number of its source, rank in it, size of its source); root: the digest of all, null without documents;
    sources and deepest bound the number of levels."""

    records: DataFrame
    leaves: DataFrame
    root: str | None
    sources: int
    deepest: int


def _parents(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The next level of nodes (keys, at, digest): runs of 16 places, with their children in order."""
    run = nodes.groupBy(*keys, F.shiftright("at", 4).alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("_kids"))
    kids = F.col("_kids")["digest"]
    return run.select(*keys, "at", F.sha2(F.array_join(kids, ""), 256).alias("digest"), kids.alias("children"))


def build(docs: DataFrame, carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of docs, whose columns doc_id, source, lang, n_chars and text count; carry adds columns to its leaves.

    Leaves of a source ascend by doc_id, null first; rows that repeat a doc_id follow by leaf digest, equal rows are leaves of
    their own. Sources ascend bytewise, null first, which is a source of its own. Null fields differ from empty ones. An
    empty table has no root. Other columns are ignored.

    Only digests, ids and sources are shuffled, never texts. A source of any size is spread over range partitions and its runs.
    """
    own = {f"_carry_{c}": v for c, v in (carry or {}).items()}
    leaves = docs.select("doc_id", "source", leaf_digest([F.col(f) for f in FIELDS]).alias("leaf"), *(v.alias(c) for c, v in own.items()))
    leaves = written(leaves.withColumn("_seq", F.monotonically_increasing_id()), "merkle-leaves")
    rows, groups = ranked(leaves, "source", [F.col("doc_id").asc_nulls_first(), "leaf", "_seq"], "merkle-ranked")
    groups = written(numbered(groups, [F.col("source").asc_nulls_first()], "merkle-sources"), "merkle-sources")
    key = lambda source: F.coalesce(F.concat(F.lit("="), source), F.lit("-"))
    numbers = groups.select(key(F.col("source")).alias("key"), F.col("row").alias("number"), "size")
    rows = looked_up(rows, numbers, key(F.col("source")), "size", ["number", "size"], F.concat(F.lit("row "), F.col("_seq").cast("string")))
    rows = written(rows.select("doc_id", "source", "leaf", "rank", "number", "size", *(F.col(c).alias(c[7:]) for c in own)), "merkle-places")
    sources, deepest = groups.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(0))).first()
    if not sources:
        return Manifest(docs.sparkSession.createDataFrame([], "digest string, children array<string>"), rows, None, 0, 0)
    records, tops = [], []
    level, left = rows.select("number", "size", F.col("rank").alias("at"), F.col("leaf").alias("digest")), deepest
    while left > 1:  # sources with one node left are done; the others go on
        tops.append(level.filter("size = 1"))
        level = written(_parents(level.filter("size > 1"), ["number", "size"]), "merkle-level")
        records.append(level)
        level, left = level.withColumn("size", F.ceil(F.col("size") / RUN)), -(-left // RUN)
    tops.append(level)
    subroots = tops[0]
    for more in tops[1:]:
        subroots = subroots.unionByName(more.select(*subroots.columns))
    level, left = subroots.select(F.col("number").alias("at"), "digest"), sources
    while left > 1:
        level, left = written(_parents(level, []), "merkle-level"), -(-left // RUN)
        records.append(level)
    root = level.first()["digest"]
    stored = None
    for part in records:
        part = part.select("digest", "children")
        stored = part if stored is None else stored.unionAll(part)
    if stored is None:
        stored = docs.sparkSession.createDataFrame([], "digest string, children array<string>")
    return Manifest(stored, rows, root, sources, deepest)


def _digits(number: Column, levels: Column, most: int) -> Column:
    """The levels lowest hexadecimal digits of number, most significant first; most bounds levels."""
    return F.substring(F.lpad(F.lower(F.hex(number)), max(most, 1), "0"), F.lit(max(most, 1) + 1) - levels, levels)


def _levels(size: Column, most: int) -> Column:
    """height() of a column, up to most."""
    out = F.lit(0)
    for k in range(most):
        out = out + F.when(size > RUN**k, 1).otherwise(0)
    return out


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """requests, some or all rows of manifest.leaves (more columns may follow), with subroot and path.

    path lists the segments from the leaf's level to the root: the digests before and after the one that goes on. Every level is a
    join of distinct digit prefixes with the records by digest: a sixteenth of the rows of the level below it. At the lowest level the
    requests of one run, at most 16 places, are met by one row. Requests for one place that repeat are answered each.
    """
    spark = requests.sparkSession
    top, deep = height(manifest.sources), height(manifest.deepest)
    upper = _digits(F.col("number"), F.lit(top), top) if top else F.lit("")
    lower = _digits(F.col("rank"), _levels(F.col("size"), deep), deep) if deep else F.lit("")
    asked = requests.withColumn("_digits", F.concat(upper, lower))
    asked = asked.withColumn("_run", F.substring("_digits", F.lit(1), F.greatest(F.length("_digits") - 1, F.lit(0))))
    # Distinct prefixes above the runs with the digits wanted next, from the bottom up: each level comes from the one below.
    ends = asked.select(F.col("_run").alias("prefix")).distinct()
    wanted, deepest = {}, max(top + deep - 1, 0)
    longer = None
    for k in range(deepest, 0, -1):
        here = ends.filter(F.length("prefix") == k)
        here = here if longer is None else here.unionAll(longer).distinct()
        wanted[k] = here = written(here, "merkle-wanted")
        longer = here.select(F.substring("prefix", 1, k - 1).alias("prefix")).distinct()
    # Down from the root.
    segment = "array<struct<before:string,after:string>>"
    frontier = spark.range(1).select(F.lit("").alias("prefix"), F.lit(manifest.root).alias("digest"), F.lit(None).cast("string").alias("subroot"), F.array().cast(segment).alias("path"))
    frontier = frontier.withColumn("subroot", F.col("digest")) if not top else frontier
    reached = [frontier]
    for k in range(1, deepest + 1):
        steps = wanted[k].select(F.col("prefix").alias("next"), F.substring("prefix", 1, k - 1).alias("prefix"))
        frontier = _down(steps.join(frontier, "prefix").join(manifest.records, "digest"), F.right("next", F.lit(1)))
        frontier = frontier.select(F.col("next").alias("prefix"), "digest", (F.col("digest") if k == top else F.col("subroot")).alias("subroot"), "path")
        frontier = written(frontier, "merkle-frontier")
        reached.append(frontier)
    runs = reached[0]
    for more in reached[1:]:
        runs = runs.unionByName(more)
    # Runs of leaves: the path travels once per run, not once per request. A lone document is the root itself and needs no record.
    kept = [F.col(c) for c in requests.columns]
    runs = runs.join(manifest.records, "digest", "left")
    found = asked.join(runs.withColumnRenamed("prefix", "_run"), "_run")
    last, lone = F.right("_digits", F.lit(1)), F.length("_digits") == 0
    here = _down(found, last, "_child", "_path")
    at_leaf = F.length("_digits") == top
    return here.select(
        *kept,
        F.when(at_leaf & ~lone, F.col("_child")).otherwise(F.col("subroot")).alias("subroot"),
        F.reverse(F.when(lone, F.col("path")).otherwise(F.col("_path"))).alias("path"),
    )


def _down(found: DataFrame, digit: Column, child: str = "digest", path: str = "path") -> DataFrame:
    """found (children, path) one level further down: the child of the hexadecimal digit, the others added to the path."""
    at = F.conv(digit, 16, 10).cast("int")
    kids = F.col("children")
    join = lambda part: F.array_join(part, "")
    segment = F.struct(join(F.slice(kids, F.lit(1), at)).alias("before"), join(F.slice(kids, at + 2, F.lit(RUN))).alias("after"))
    return found.withColumns({child: F.get(kids, at), path: F.concat("path", F.array(segment))})


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]), 256))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its proof, checked against a tampered text where 5 divides the id's CRC."""
    docs = table(spark, sf_dir, "documents")
    altered = leaf_digest([F.translate("text", UPPER, LOWER) if f == "text" else F.col(f) for f in FIELDS])
    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, altered)
    manifest = build(docs, {"tampered": shown})
    if manifest.root is None:
        return manifest.leaves.selectExpr("doc_id", "leaf", "leaf AS subroot", "leaf AS root", "leaf AS proof_sha256", "leaf AS folded_root", "true AS verified")
    proved = prove(manifest, manifest.leaves).withColumn("root", F.lit(manifest.root))
    checked = proved.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return checked.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Levels that the SQL unrolls below and above the subroots: up to 16**5 documents a source, 16**3 sources.
_DEEP, _TOP = 5, 3


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join([_field_sql("CAST(doc_id AS VARCHAR)"), _field_sql("source"), _field_sql("lang"), _field_sql("CAST(n_chars AS VARCHAR)"), _field_sql(text)]) + ")"


def _level_sql(k: int) -> str:
    """Level k + 1 from level k: a row per node (part, place, digest) and per node its siblings' digests (before, after, alone)."""
    part, place = ("source", "place") if k < _DEEP else ("CAST(NULL AS VARCHAR)", "place")
    node = f"n{k}" if k < _DEEP else f"(SELECT CAST(NULL AS VARCHAR) AS source, place, digest FROM n{k})"
    if k == _DEEP:
        node = f"(SELECT CAST(NULL AS VARCHAR) AS source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, digest FROM n{k})"
    return f"""c{k} AS (SELECT source, {place}, digest, count(*) OVER (PARTITION BY {part}) AS many FROM {node}),
g{k} AS (SELECT source, place // 16 AS up, any_value(many) AS many, list(digest ORDER BY place) AS kids FROM c{k} GROUP BY ALL),
n{k + 1} AS (SELECT source, up AS place, CASE WHEN many = 1 THEN kids[1] ELSE sha256(array_to_string(kids, '')) END AS digest FROM g{k})"""


def _climb_sql(k: int) -> str:
    """Level k + 1 of the proofs: siblings so far and the folded digest; at the subroots the source's number takes over as the place."""
    place = "p.place" if k != _DEEP else "s.number"
    more = " JOIN numbers s ON s.source IS NOT DISTINCT FROM p.source" if k == _DEEP else ""
    same = "g.source IS NOT DISTINCT FROM p.source AND " if k < _DEEP else ""
    before, after = f"array_to_string(g.kids[1:{place} % 16], '')", f"array_to_string(g.kids[{place} % 16 + 2:], '')"
    return f"""p{k + 1} AS (SELECT p.doc_id, p.source, p.leaf, {place} // 16 AS place,
  CASE WHEN g.many = 1 THEN p.siblings ELSE p.siblings || {before} || {after} END AS siblings,
  CASE WHEN g.many = 1 THEN p.fold ELSE sha256({before} || p.fold || {after}) END AS fold
  FROM p{k} p{more} JOIN g{k} g ON {same}g.up = {place} // 16)"""


ORACLE = f"""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS place, {_leaf_sql('text')} AS leaf,
  CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered FROM documents),
n0 AS (SELECT source, place, leaf AS digest FROM d),
{", ".join(_level_sql(k) for k in range(_DEEP + _TOP))},
numbers AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS number, digest FROM n{_DEEP}),
p0 AS (SELECT doc_id, source, leaf, place, '' AS siblings, coalesce(tampered, leaf) AS fold FROM d),
{", ".join(_climb_sql(k) for k in range(_DEEP + _TOP))}
SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, sha256(p.siblings) AS proof_sha256, p.fold AS folded_root, p.fold = r.digest AS verified
FROM p{_DEEP + _TOP} p JOIN numbers s ON s.source IS NOT DISTINCT FROM p.source CROSS JOIN n{_DEEP + _TOP} r
"""
