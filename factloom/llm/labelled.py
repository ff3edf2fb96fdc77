"""Bounded samples of labelled documents, and which documents are held out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(folds: int) -> Column:
    """crc32 of the doc_id as text, modulo the number of folds; null without a doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int) -> DataFrame:
    """doc_id, text, label (0 or 1) of at most per_class documents a class, drawn by a hash of doc_id.

    `learn` says which documents may be learned from. A document with several labels counts as the greatest of them;
    of documents that repeat a doc_id the least text is used, so that every run learns the same. Null labels and null doc_ids give nothing.
    """
    one = labels.filter(learn & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))
    picked = None
    for k in (0, 1):
        part = one.filter(F.col("label") == k).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
