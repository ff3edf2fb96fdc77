"""Streams of fact lines into facts, and windowed counts of them with late facts bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.text import parsed


def stream_facts(spark: SparkSession, folder: str, graph: str) -> DataFrame:
    """Facts of the text files that arrive in a folder."""
    return parsed(spark.readStream.text(folder), graph)


def append(facts: DataFrame, target: str, checkpoint: str):
    """A query that adds arriving facts to a folder of Parquet, each once: one that an earlier batch brought changes nothing."""
    keys = ["graph", "s", "p", "o"]

    def write(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(keys)
        if number:
            # what this batch may have left when it failed is not counted as there
            schema = batch.select(*keys).schema.add("batch", "long")
            there = batch.sparkSession.read.schema(schema).parquet(target).filter(F.col("batch") < number)
            new = new.join(there.join(new.select(*keys), keys, "left_semi"), keys, "left_anti").select(*batch.columns)
        # a folder a batch: a batch that is run again after a failure replaces what it left
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return facts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(facts: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Facts by predicate's name and window of their anchors; facts later than `late` are left out."""
    at = F.timestamp_micros(F.call_function("div", F.col("p_ns"), F.lit(1000)))
    timed = facts.filter("p_ns is not null").withColumn("at", at).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "p_id").agg(F.count("*").alias("n"))
