"""Operator 8: exact duplicates by skew-safe combining, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.llm.common import LOWER, UPPER, looked_up, table, written

#: Salts a digest's rows may take in the first merge, so a digest with a third of all rows
#: is merged by this many tasks and the last merge sees at most this many rows of it.
SALTS = 64


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest_bits: int = 256,
    keep: list[str] | None = None,
) -> DataFrame:
    """Group rows whose texts are identical after lower-casing A-Z; the largest id of a group stays.

    Returns one row per input row: id_col, keep_id, group_size, kept, text_sha256, and the
    columns named in keep, which must not clash with these.

    Three combining steps compare (digest, whole normalised text), never the digest alone:
    the map-side aggregate deduplicates inside each input partition, the first shuffle merges
    the groups of a digest under a salt, the second merges the salt winners. Only text-free
    rows are joined back, those of the few digests with a thousandth of all rows or more by broadcast. Digests that carry several different texts are resolved by joining
    the winners' texts; digest_bits shortens the grouping digest so that tests can force this.

    Defined cases: null text equals the empty text; a null id loses against any other id, and
    keep_id is null if all ids of a group are null; rows that repeat id and text all
    carry the winner's mark and each counts in group_size; texts of any length are compared and hashed whole, and one is a row in
    the shuffle of its digest's group; an empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    if taken := {id_col, "keep_id", "group_size", "kept", "text_sha256"} & set(keep or []):
        raise ValueError(f"{sorted(taken)} are columns of the result")
    extra = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep or [])]
    base = docs.select(
        *extra,
        F.col(id_col).alias("doc_id"),
        F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER).alias("norm"),
    ).withColumn("text_sha256", F.sha2("norm", 256))
    base = base.withColumn("digest", F.substring("text_sha256", 1, max(1, digest_bits // 4)))

    salted = (
        base.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "norm", "salt")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    winners = (
        salted.repartition("digest")
        .groupBy("digest", "norm")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
        .select(
            "digest",
            F.sha2("norm", 256).alias("winner_sha256"),
            "keep_id",
            "group_size",
            F.count(F.lit(1)).over(W.partitionBy("digest")).alias("n_texts"),
        )
    )
    winners = written(winners, "exact-winners")

    more = [f"kept_{i}" for i in range(len(extra))]
    out = ["doc_id", "keep_id", "group_size", "text_sha256", *more]
    lone = winners.filter("n_texts = 1").select(F.col("digest").alias("key"), "keep_id", "group_size")
    spread = F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))
    rows = base.select("doc_id", "digest", "text_sha256", *more)
    result = looked_up(rows, lone, F.col("digest"), "group_size", ["keep_id", "group_size"], spread).filter("group_size IS NOT NULL").select(*out)
    shared = winners.filter("n_texts > 1")
    if not shared.isEmpty():
        # Different texts under one digest: fetch each winner's text and compare whole texts.
        texts = (
            base.select(F.col("doc_id").alias("keep_id"), F.col("norm").alias("keep_norm"), "digest")
            .join(shared.withColumnRenamed("keep_id", "k"), "digest", "inner")
            .filter(F.col("keep_id").eqNullSafe(F.col("k")) & (F.sha2("keep_norm", 256) == F.col("winner_sha256")))
            .select("digest", "keep_id", "keep_norm", "group_size")
            .dropDuplicates(["digest", "keep_id", "keep_norm"])
        )
        result = result.unionByName(
            base.join(texts, (base["digest"] == texts["digest"]) & (F.col("norm") == F.col("keep_norm"))).select(*out)
        )
    return result.select(
        F.col("doc_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        *(F.col(m).alias(c) for m, c in zip(more, keep or [])),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with the document that stands for its text."""
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
