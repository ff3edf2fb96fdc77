"""From raw documents to token ids: quality rules, line dedup, near-dedup, mixing to weights, BPE.

Every stage but the last returns the columns of its input, others than those of documents as well, whatever they are called. Defined results by stage:

* Nulls: a null text fails the quality rules, and in the later stages is the empty one; a null doc_id neither holds nor loses lines, and its row stays in
  near-dedup; a null source is a source of its own.
* Empty and very long texts: empty ones fail the rules; a document may be left empty by line dedup, and empty ones are then near copies of each other; long ones
  are read whole by each stage.
* Ties and repeats: of equal lines and of near copies the smallest doc_id keeps its own; rows that share a doc_id are one document in line dedup, and one of them stays in
  near-dedup; the mix repeats rows.
* An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, line_dedup, mixing, quality_rules, simhash


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules."""
    return quality_rules.kept_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that another one holds first; n_chars is the new length."""
    return line_dedup.deduplicated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights; a document that is taken twice is two rows."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and ids (little-endian unsigned 32-bit integers) of every row of the mix."""
    found = bpe.encoded(docs.select("doc_id", "source", "lang", "text"))
    return found.select("doc_id", "source", "lang", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", rules), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("mixing", mix), ("BPE", tokens)]

#: zstandard, SimHash components and BPE have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
