"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_main, line_dedup, media, mixing, quality, quality_rules, secrets, simhash, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extracted(table(spark, sf_dir, "pages"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the documents as a history of two ages, of which the second is scanned against the first one's ledger
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    findings, _ = secrets.scan_history(docs, F.pmod(F.xxhash64("doc_id"), F.lit(2)), 2)
    return secrets.digest(findings)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.read_back(media.stored(table(spark, sf_dir, "documents"))))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_simhash": op2_simhash,
    "op3_html": op3_html,
    "op4_mix": op4_mix,
    "op5_secrets": op5_secrets,
    "op6_quality_rules": op6_quality_rules,
    "op7_toxicity": op7_toxicity,
    "op8_bpe": op8_bpe,
    "op9_media": op9_media,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op4_mix": mixing.ORACLE_SQL,
    "op5_secrets": secrets.ORACLE_SQL,
    "op10_line_dedup": line_dedup.ORACLE_SQL,
}
