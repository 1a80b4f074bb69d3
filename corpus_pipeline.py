"""From raw documents to packed training sequences: five stages over the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, in the columns of
the table; the last returns the pieces of the packed sequences. Between stages the rows are
written as Parquet and read again, so every stage starts from a file and survives lost executors.

All stages take whole texts of any length, empty tables, and tables with more columns, which are left out
whatever their names; the columns of documents must be there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import table, written
from loomgraph.llm.exact_dedup import exact_dedup
from loomgraph.llm.langid import fit_documents, identify
from loomgraph.llm.minhash import near_dedup
from loomgraph.llm.packing import pack
from loomgraph.llm.pii import find_pii
from loomgraph.sources.tables import discarded

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters or like no known language go.

    Null, empty and letterless texts are rejected; rows that repeat are judged alike; ties go to the first language by name.
    Models are fitted on documents that are not held out.
    """
    found = identify(docs, fit_documents(docs), keep=COLUMNS[1:])
    return found.filter("NOT rejected").select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lowered) the document with the largest id; rows that repeat id and text stay once.

    Null text equals the empty text; a null id loses against any other. Equal texts under one id are a tie: any one row stays.
    """
    found = exact_dedup(docs, keep=COLUMNS[1:]).filter("kept")
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        found = found.dropDuplicates(["doc_id", "text_sha256"])
    return found.select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least id, of each group linked by shingle similarity.

    Null ids stay; null and blank texts are linked with nothing; rows that repeat an id stay or go together. There are no ties, since the least id stays.
    """
    kept = near_dedup(docs).filter("kept").select(F.col("doc_id").alias("id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["id"]), "left_semi").select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind in brackets; n_chars follows the new text.

    Null text stays null and keeps its n_chars; rows that repeat are treated alike.
    """
    found = find_pii(docs.select(*COLUMNS), redact=True)
    return found.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens, with their token ids.

    Null and empty texts are the end token alone; rows that repeat are packed one by one. Pieces of equal length are ordered by where
    they stand in the table; which sequence takes which of them has no meaning.
    """
    return pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the language models, the boosted trees nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents table; a stage's file goes once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discarded(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
